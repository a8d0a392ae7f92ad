"""Null ids, clashing and dotted names, ties, the channel's decoder against enumeration, and the pipeline's stages."""

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from credsieve.llm import chat, exact_dedup, line_dedup, minhash, mixing, packing, quality, queries, simhash, tokens, toxicity

CLASHING = (
    "doc_id long, text string, source string, lang string, n_chars long, `a.b` int, kept int, group_size int, piece int, start string, "
    "length int, score string, predicted string, size int, taken int, n_lines int, removed string, component_id string, fingerprint string, n_tokens string"
)


def row(k, text, source="s", lang="en"):
    return (k, text, source, lang, len(text or ""), *([7] * 4), "x", 7, "x", "x", *([7] * 3), *(["x"] * 4))


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, null and empty texts, repeated rows and equal texts, with names that clash with every result."""
    rows = [row(None, "one two three four\nfive six seven eight nine"), row(None, None), row(1, ""), row(2, "one two three four\nfive six seven eight nine"), row(2, "one two three four\nfive six seven eight nine"), row(3, "a b c", None, None)]
    return spark.createDataFrame(rows, CLASHING)


def test_operators_with_null_ids_and_clashing_names(spark, odd):
    path = queries.tokenizer_path()
    assert exact_dedup.duplicate_report(odd).where("kept").count() == 3
    stay = exact_dedup.drop_duplicates(odd)
    assert stay.columns == odd.columns and sorted((r["doc_id"] or -1, r["a.b"]) for r in stay.collect()) == [(1, 7), (2, 7), (3, 7)]
    assert packing.pack_documents(odd, path).count() == 6
    counts = tokens.token_counts(odd, path).collect()
    assert len(counts) == 6 and Counter(r["doc_id"] for r in counts)[None] == 2
    assert minhash.edited_report(odd).count() == 6
    near = simhash.near_duplicates(odd).collect()
    assert len(near) == 6 and {r["component_id"] for r in near} == {1, 2, 3}
    left = simhash.drop_near_duplicates(odd)
    assert left.columns == odd.columns and sorted(r["doc_id"] for r in left.collect()) == [1, 2, 3]
    lines = line_dedup.without_repeated_lines(odd).collect()
    assert len(lines) == 6 and {r["doc_id"]: r["n_removed"] for r in lines if r["doc_id"]} == {1: 0, 2: 0, 3: 0}
    assert sorted(r["n_removed"] for r in lines if r["doc_id"] is None) == [0, 2]
    mix = mixing.mixed(odd)
    assert mix.columns == odd.columns and mixing.mixture(odd).agg(F.sum("taken")).first()[0] > 0
    labels = spark.createDataFrame([(None, 1, 1), (1, 0, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    for made in (quality, toxicity):
        name = "quality" if made is quality else "toxic"
        model = made.fit(odd, labels, quality.fold("doc_id", 4) != 2, label=name) if made is quality else made.fit(odd, labels, quality.fold("doc_id", 3) != 1)
        assert made.scores(odd, model).where("score between 0 and 1").count() == 6
    assert odd.select((quality.fold("doc_id", 4) == 2).alias("held_out")).where("held_out is null").count() == 0


def test_mixing_cuts_within_deep_ranges(spark, monkeypatch):
    """Every cut is found by several levels of ranges, and as exactly as by one."""
    rng = random.Random(2)
    rows = [(k, "w " * rng.randrange(9), f"s{k % 3}") for k in range(900)] + [(5, "w w", "s2")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    whole = Counter(map(tuple, mixing.mixture(df).collect()))
    monkeypatch.setattr(mixing, "RANGE_ROWS", 1)
    assert Counter(map(tuple, mixing.mixture(df).collect())) == whole
    sums = mixing.mixture(df).groupBy("source_size").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 40 for r in sums)


def test_predictions_at_the_threshold(spark):
    """A score of exactly the threshold predicts label 1."""
    model = toxicity.Model(np.zeros((28, 28, 28)), weights=(float(np.log(0.5 / 0.5)), 0.0, 0.0, 0.0))
    found = toxicity.scores(spark.createDataFrame([(1, "x")], "doc_id long, text string"), model, threshold=0.5).first()
    assert (found["score"], found["predicted"]) == (0.5, 1)


def steps(seen):
    """What the channel may have done to write a character: (letter, repeated, cost); no letter is a separator."""
    letters = [(seen, 0.0)] if seen.isalpha() else [(x, toxicity.SUBSTITUTED) for x in toxicity.LOOK_ALIKES.get(seen, "")]
    found = [(x, again, cost + again * toxicity.REPEATED) for x, cost in letters for again in (0, 1)]
    return found + [("", 0, toxicity.SEPARATED)] * (seen in toxicity.SEPARATORS or not letters)


def decoded_by_hand(word, costs):
    """All paths of the channel, one by one: the readings of least cost."""
    found = []
    for path in itertools.product(*map(steps, word)):
        letters, ok = [], True
        for letter, again, _ in path:
            if again:
                ok = ok and letters[-1:] == [letter]
            elif letter:
                letters.append(letter)
        if ok:
            symbols = [0, 0, *map(toxicity._symbol, letters), 0]
            cost = sum(x[2] for x in path) + sum(costs[a, b, c] for a, b, c in zip(symbols, symbols[1:], symbols[2:]))
            found.append((cost, "".join(letters)))
    least = min(found)[0]
    return {x for cost, x in found if cost <= least + 1e-6}


def test_decoder_against_enumeration():
    rng = random.Random(3)
    costs = toxicity.character_costs(toxicity.trigram_counts(b"the cat sat on a mat with idiot trash loser llama book see " * 20))
    words = ["1d1ot", "tra$h", "ll4ma", "b00k", "s-e-e", "lo$er", "se3", "tt.aa", "@@t", "1l1"]
    words += ["".join(rng.choice("ae1l0o$-.t") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    for word in words:
        if word.isalpha() and not toxicity._DOUBLE.search(word):
            continue
        if any(x.isalpha() or x in toxicity.LOOK_ALIKES for x in word):
            by_hand = decoded_by_hand(word, costs)
            assert toxicity.restored(word, costs) in {x or word for x in by_hand}, word


def test_skeletons_keep_what_the_channel_keeps():
    model = toxicity.Model(toxicity.character_costs(toxicity.trigram_counts(b"idiot trash stupid " * 50)))
    rng = random.Random(4)
    for _ in range(400):
        word = "".join(rng.choice("ab1i0o$5-.(!té") * rng.randint(1, 2) for _ in range(rng.randint(1, 7)))
        edges = {toxicity.skeleton(word), toxicity.skeleton(word.strip(toxicity._EDGES))}
        assert {toxicity.skeleton(x) for x in model.readings(word)} <= edges, word


def test_read_back_needs_no_order(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", f"said {c} {t}") for c in range(6) for t in range(5)]
    made = chat.examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    expected = sorted(map(tuple, chat.read_back(made).collect()))
    kept = spark.createDataFrame(made.collect(), made.schema).orderBy(F.rand(1))
    assert sorted(map(tuple, chat.read_back(kept).collect())) == expected


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(9)
    plain = ["".join(rng.choice(["ba", "ko", "li", "mu", "ne", "ra"]) for _ in range(3)) for _ in range(120)]
    texts = [" ".join(rng.choice(plain) for _ in range(60)) for _ in range(240)]
    rude = {k for k in range(240) if k % 5 == 0}
    texts = [t + " zorgblat" if k in rude else t for k, t in enumerate(texts)]
    texts += [texts[1], texts[2].replace(" ", "  "), texts[3] + " tail", None, ""]
    rows = [row(k, t, f"s{k % 3}") for k, t in enumerate(texts)] + [row(None, texts[1])]
    top = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, CLASHING).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(k, int(k in rude), 1) for k in range(240)], "doc_id long, toxic int, quality int").write.parquet(f"{top}/labels.parquet")
    return str(top), texts, rude


def test_pipeline_stages(spark, corpus):
    top, texts, rude = corpus
    docs, tables = spark.read.parquet(f"{top}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, top)
        tables.append(docs.collect())
        docs = spark.createDataFrame(tables[-1], docs.schema)
        if k < 4:
            assert docs.columns == [c.split()[0].strip("`") for c in CLASHING.split(", ")]
    clean, once, near, mix, pieces = tables
    assert {r["doc_id"] for r in clean} == {None, *range(245)} - rude
    assert Counter(r["doc_id"] for r in once) == Counter({*range(245)} - rude - {240, 241, 244})
    component = {}
    for r in once:
        component.setdefault(simhash.fingerprint((r["text"] or "").encode()), r["doc_id"])
    prints = sorted(component)
    parent = {p: p for p in prints}

    def top_of(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= 2:
            parent[top_of(a)] = top_of(b)
    groups = {}
    for r in once:
        groups.setdefault(top_of(simhash.fingerprint((r["text"] or "").encode())), []).append(r["doc_id"])
    assert sorted(r["doc_id"] for r in near) == sorted(map(min, groups.values()))
    source = {r["doc_id"]: r["source"] for r in near}
    targets = {source[r["doc_id"]]: r["target"] for r in mixing.mixture(spark.createDataFrame(near, docs_schema(spark, top))).collect()}
    words = Counter()
    for r in mix:
        words[r["source"]] += len((r["text"] or "").split())
        assert r["n_chars"] == len(r["text"] or "")
    assert {s: n for s, n in words.items() if s in targets} == pytest.approx(targets, abs=2) and set(words) == set(targets)
    ids = tokens.encoder(queries.tokenizer_path())
    expected = sum(len(ids.ids(r["text"] or "")) // 4 + 1 for r in mix)
    assert sum(r["length"] for r in pieces) == expected and max(r["length"] + r["offset"] for r in pieces) <= 1024
    whole = corpus_pipeline.run(spark, top).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in whole) == Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces)


def docs_schema(spark, top):
    return spark.read.parquet(f"{top}/documents.parquet").schema


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], CLASHING).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
