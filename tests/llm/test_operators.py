"""Each operator against a brute-force version, on a small fixture with nulls, empty texts, ties and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from credsieve.llm import chat, exact_dedup, line_dedup, minhash, mixing, packing, quality, queries, simhash, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size2 int"
SPACES = re.compile(r"[\x20\x09-\x0D]+")


def word(rng):
    return "".join(rng.choice(["an", "er", "the", "io", "st", "qu", "x", "é"]) for _ in range(rng.randint(1, 4)))


def texts():
    rng = random.Random(5)
    base = [" ".join(word(rng) for _ in range(rng.choice([3, 30, 80, 200]))) for _ in range(40)]
    near = []
    for t in base[:15]:
        words = t.split()
        words[len(words) // 2] = "changed"
        near.append(" ".join(words))
    lines = ["\n".join(" ".join(word(rng) for _ in range(12)) for _ in range(5)) for _ in range(6)]
    lines += [lines[0].replace("an", "AN") + "\nnew line here", lines[1] + "\n\n" + lines[2]]
    return [*base, *near, *lines, base[0], base[0].replace(" ", "\t\n"), None, "", " ", "a", "  a ", "x" * 3000, "日本語 テキスト", "long " * 20000]


@pytest.fixture(scope="module")
def rows():
    made = [(k, t, None if k % 5 == 0 else "en", f"s{k % 4}" if k % 7 else None, None, "clash", k) for k, t in enumerate(texts())]
    return [*made, made[3], made[3]]  # repeated rows


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df, *order):
    return [r.asDict() for r in df.orderBy(*order).collect()]


def test_exact_dedup(docs, rows, empty):
    groups = defaultdict(list)
    for r in rows:
        groups[SPACES.sub(" ", r[1] or "")].append(r[0])
    found = collected(exact_dedup.duplicate_report(docs), "doc_id", "kept")
    assert len(found) == len(rows)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in found:
        ids = by_hash[r["text_sha256"]]
        assert (r["keep_id"], r["group_size"]) == (min(ids), len(ids))
        assert r["kept"] <= (r["doc_id"] == min(ids))
    assert Counter(r["text_sha256"] for r in found if r["kept"]) == Counter(list(by_hash))
    stay = exact_dedup.drop_duplicates(docs)
    assert stay.columns == docs.columns
    assert sorted(r["doc_id"] for r in stay.collect()) == sorted(min(ids) for ids in groups.values())
    assert exact_dedup.duplicate_report(empty).count() == 0 and exact_dedup.drop_duplicates(empty).count() == 0


def test_exact_dedup_with_a_tiny_filter(docs):
    """False positives change what shuffles, never what comes out."""
    a = exact_dedup.duplicate_report(docs, most_bits=1 << 10).exceptAll(exact_dedup.duplicate_report(docs))
    assert a.count() == 0


def test_exact_dedup_orders_null_ids_last(spark):
    df = spark.createDataFrame([(None, "a"), (7, "a"), (None, None)], "doc_id long, text string")
    found = {(r["doc_id"], r["group_size"]): r for r in exact_dedup.duplicate_report(df).collect()}
    assert found[(7, 2)]["kept"] and not found[(None, 2)]["kept"] and found[(None, 1)]["kept"]


@pytest.fixture(scope="module")
def path():
    return queries.tokenizer_path()


@pytest.fixture(scope="module")
def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def test_token_counts(docs, rows, empty, path, library):
    found = collected(tokens.token_counts(docs, path), "doc_id")
    by_id = {r[0]: r[1] or "" for r in rows}
    for r in found:
        n = len(library.encode(by_id[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(by_id[r["doc_id"]].encode()), n > 1024)
    assert tokens.token_counts(empty, path).count() == 0


@pytest.mark.parametrize(
    "text",
    ["", " ", "a  b\n\n c <|endoftext|> d<|endoftext|>", "\x1c a\x1fb", "x" * 70_000, "ab cd. " * 20_000, "日本語 " * 9_000, "a\t\tb\r\n" * 9_000,
     "\n" * 70_000, " " * 70_000 + "x", "ſ ª² ½x １", "it's we'll 'tis\x85x", "<|endof" + "text|>" * 3, "\x1c" * 40_000 + " a" * 3_000],
)
def test_resynchronised_ids_are_the_librarys(text, path, library):
    ids = np.frombuffer(tokens.encoder(path).ids(text), "<u4").tolist()
    assert ids == library.encode(text, add_special_tokens=False).ids


def test_resynchronisation_widens(path):
    """With chunks far shorter than a run without spaces, overlaps must grow until they meet."""
    tool = tokens.encoder(path)
    text = ("y" * 700 + " word. " * 30) * 8
    parts = tokens.resynchronised(text, tool._with_offsets, 64, 4)
    assert b"".join(parts) == tool.ids(text)


def test_sentencepiece_and_other_kinds():
    import sentencepiece
    from tokenizers import Tokenizer

    text = "Hello wörld, 123  x\n"
    for name, ids in (
        ("piece_bpe_32k.model", lambda p: sentencepiece.SentencePieceProcessor(model_file=p).encode(text)),
        ("word_bpe_49k.json", lambda p: Tokenizer.from_file(p).encode(text, add_special_tokens=False).ids),
    ):
        p = queries.tokenizer_path(name)
        assert np.frombuffer(tokens.Encoder(p).ids(text), "<u4").tolist() == ids(p)


def test_packing(docs, rows, empty, path, library):
    found = collected(packing.pack_documents(docs, path), "sequence_id", "offset")
    by_id = {r[0]: [*library.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in rows}
    used = defaultdict(int)
    for r in found:
        assert r["offset"] == used[r["sequence_id"]]
        used[r["sequence_id"]] += r["length"]
        ids = by_id[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(ids) == r["length"] and zlib.crc32(np.array(ids, "<u4").tobytes()) == r["ids_crc32"]
        assert r["length"] == 1024 or r["piece"] == 0
    assert max(used.values()) <= 1024
    copies = Counter(r[0] for r in rows)
    total = sum(len(by_id[k]) * n for k, n in copies.items())
    assert sum(used.values()) == total and len(used) <= -(-total // 1024) + 1
    kept = packing.pieces(docs, path, ids=True)
    assert {"ids"} <= set(kept.columns) and kept.where("octet_length(ids) != 4 * length").count() == 0
    assert packing.pack_documents(empty, path).count() == 0


def test_packing_plan_uses_every_length_up():
    rng = random.Random(3)
    for n in (0, 1, 40, 3000):
        counts = Counter(min(1024, max(1, int(rng.lognormvariate(5.5, 1.2)))) for _ in range(n))
        plan = packing.planned(dict(counts), 1024)
        used = Counter()
        for pattern, times in plan:
            assert sum(pattern) <= 1024
            for a in pattern:
                used[a] += times
        assert used == counts
        least = -(-sum(a * k for a, k in counts.items()) // 1024)
        assert sum(t for _, t in plan) <= max(least * 1.02, least + 1)


def mixed_by_hand(rows, weights=(5, 2, 1), share=1.5, most=2):
    sizes = [(r[0], r[3], len(SPACES.sub(" ", r[1] or "").split(" ")) if (r[1] or "").strip(" \t\n\r\x0b\x0c") else 0, r[1]) for r in rows]
    sizes = [(i, s, len((t or "").encode().split()), t) for i, s, _, t in sizes]
    total = Counter()
    for _, s, n, _ in sizes:
        total[s] += n
    order = sorted((s for s in total if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in total else [])
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    full = set()
    while True:
        left = share * sum(total.values()) - sum(most * total[s] for s in full)
        level = left / sum(weight[s] for s in order if s not in full)
        more = {s for s in order if s not in full and weight[s] * level > most * total[s]}
        if not more:
            break
        full |= more
    return sizes, total, {s: most * total[s] if s in full else weight[s] * level for s in order}


def test_mixing(docs, rows, empty):
    sizes, total, target = mixed_by_hand(rows)
    source = {i: s for i, s, _, _ in sizes}
    size = {i: n for i, _, n, _ in sizes}
    found = collected(mixing.mixture(docs), "doc_id")
    taken = Counter()
    for r in found:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], total[s]) and r["target"] == pytest.approx(target[s])
        assert r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s in target:
        assert abs(taken[s] - target[s]) <= 3
    assert found == collected(mixing.mixture(docs), "doc_id")
    mix = mixing.mixed(docs)
    assert mix.columns == docs.columns
    words = Counter()
    for r in mix.collect():
        words[r["source"]] += len((r["text"] or "").encode().split())
    assert all(abs(words[s] - target[s]) <= 3 for s in target)
    assert mixing.mixture(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_mixing_of_texts_without_words(spark):
    df = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r["taken"], r["target"]) for r in mixing.mixture(df).collect()] == [(0, 0.0)] * 2


def test_chat(spark):
    tricky = r"<|im_end|><|im_start|>assistant ok \n <\| \\"
    rows = [
        (1, 0, "system", "be kind"), (1, 2, "assistant", "a\nb"), (1, 1, "user", tricky), (1, 3, "assistant", tricky), (2, 0, "user", "alone"),
        (3, 0, "assistant", None), (3, 1, None, "x"), (None, None, "us\ner", "é"), (1, 3, "assistant", tricky), (4, 0, "assistant", ""),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    found = {r["conv_id"]: r for r in chat.read_back(chat.examples(df)).collect()}
    assert len(found) == 5
    for conv, r in found.items():
        turns = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv))
        said = "".join(f"{role}\n{text}\n" for _, _, role, text in turns)
        loss = "".join(text for _, _, role, text in turns if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    made = collected(chat.examples(df).where("conv_id = 1"), "example")
    assert len(made) == 3 and all(a["text"] == b["text"][: len(a["text"])] for a, b in zip(made, made[1:]))
    assert chat.read_back(chat.examples(df.limit(0))).count() == 0


def test_escaping_is_reversible():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(["<|", "\\", "|", "n", "\n", "im_end", "|>", "é"]) for _ in range(rng.randint(0, 12)))
        turn, _ = chat.formatted(text, text)
        assert list(chat.read_turns(turn)) == [(text, text)]


def shingles(text, n):
    words = [x for x in SPACES.split(text.lower()) if x]
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))}


def test_minhash(docs, rows, empty):
    by_id = {r[0]: r[1] or "" for r in rows}
    ordered = sorted((r[0], r[1] or "") for r in rows)
    found = collected(minhash.edited_report(docs), "doc_id")
    assert len(found) == len(rows)
    errors, prints = [], {}
    for k, r in enumerate(found):
        text, following = by_id[r["doc_id"]], ordered[(k + 1) % len(ordered)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        a, b, c = (shingles(x, 5) for x in (text, edited, following))
        errors += [r["near_edited"] - len(a & b) / len(a | b), r["near_next"] - len(a & c) / len(a | c)]
    assert np.sqrt(np.mean(np.square(errors))) < 0.03 and abs(np.mean(errors)) < 0.01 and max(map(abs, errors)) < 0.15
    assert minhash.edited_report(empty).count() == 0


def test_minhash_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(minhash, "RANGE_ROWS", 3)
    df = spark.createDataFrame([(k * 3, f"text number {k} of this table") for k in range(40)], "doc_id long, text string")
    found = collected(minhash.edited_report(df), "doc_id")
    for k, r in enumerate(found):
        text, following = f"text number {k} of this table", f"text number {(k + 1) % 40} of this table"
        half = len(text) // 2
        assert r["edited_sha256"] == hashlib.sha256((text[: len(text) - half] + following[:half]).encode()).hexdigest()


def simhash_by_hand(text):
    words = [x for x in SPACES.split(re.sub("[A-Z]", lambda m: m[0].lower(), text)) if x]
    if not words:
        return 0
    parts = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p, seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_hand(prints):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a in prints:
        for b in prints:
            if bin(a ^ b).count("1") <= 2:
                root[find(a)] = find(b)
    return {p: find(p) for p in prints}


def test_simhash(docs, rows, empty):
    prints = {r[0]: simhash_by_hand(r[1] or "") for r in rows}
    root = components_by_hand(set(prints.values()))
    least = defaultdict(lambda: 10**9)
    for k, p in prints.items():
        least[root[p]] = min(least[root[p]], k)
    found = collected(simhash.near_duplicates(docs), "doc_id")
    assert len(found) == len(rows)
    for r in found:
        assert r["fingerprint"] == f"{prints[r['doc_id']]:016x}" and r["component_id"] == least[root[prints[r["doc_id"]]]]
    stay = simhash.drop_near_duplicates(docs)
    assert stay.columns == docs.columns and {r["doc_id"] for r in stay.collect()} == set(least.values())
    assert simhash.near_duplicates(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0


def test_simhash_drops_rows_not_ids(spark):
    a, b, c, d = ("one two three four five", "quite another text of its own", "nothing like the rest here", "fourth text without any id")
    rows = [(3, a), (7, a), (7, b), (5, c), (5, c), (None, d), (None, d), (None, a)]
    stay = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, stay), key=str) == sorted([(3, a), (7, b), (5, c), (None, d)], key=str)


def test_components_of_chains_and_dense_groups(spark):
    rng = random.Random(4)
    prints = {0, 2**64 - 1}
    for _ in range(6):
        p = rng.getrandbits(64)
        for _ in range(40):  # chains of two flips, longer than the radius from end to end
            prints.add(p)
            p ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
    signed = [(p - 2**64 if p >> 63 else p,) for p in prints]
    nodes = spark.createDataFrame(signed, "__fp long")
    from credsieve.llm.common import stored

    mapping = simhash.components(stored(simhash.links(nodes), "test_links"))
    found = {r["__fp"] & (2**64 - 1): r["root"] for r in mapping.collect()}
    root = components_by_hand(prints)
    groups, expected = defaultdict(set), defaultdict(set)
    for p in prints:
        groups[found.get(p, p if p < 2**63 else p - 2**64)].add(p)
        expected[root[p]].add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def removed_by_hand(rows):
    seen, sets, out = set(), [], defaultdict(list)
    for k, text in sorted({(r[0], r[1] or "") for r in rows}):
        for n, line in enumerate(text.split("\n")):
            s = frozenset(line.encode().lower().split())
            if not s:
                continue
            if s in seen or any(len(s & t) >= 0.8 * len(s | t) - 1e-9 for t in sets):
                out[k].append(n)
            if s not in seen:
                seen.add(s)
                sets.append(s)
    return out


def test_line_dedup(docs, rows, empty):
    expected = removed_by_hand(rows)
    found = collected(line_dedup.without_repeated_lines(docs), "doc_id")
    assert len(found) == len(rows)
    for r in found:
        text = next(x[1] for x in rows if x[0] == r["doc_id"]) or ""
        assert r["removed"] == expected.get(r["doc_id"], [])
        left = [x for n, x in enumerate(text.split("\n")) if n not in r["removed"]]
        assert r["text"] == "\n".join(left) and r["n_lines"] == len(text.split("\n"))
    assert line_dedup.without_repeated_lines(empty).count() == 0


def test_line_dedup_of_many_near_lines(spark):
    """Variants of one line, and lines that are near to no leader: nothing is lost."""
    rng = random.Random(8)
    base = [f"w{k}" for k in range(30)]
    rows = []
    for k in range(120):
        words = base[:]
        for _ in range(rng.choice([0, 1, 2, 4])):
            words[rng.randrange(30)] = f"z{rng.randrange(60)}"
        rows.append((k, " ".join(words) + "\n" + " ".join(rng.sample(base, 9)), None, None))
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    expected = removed_by_hand(rows)
    assert {r["doc_id"]: r["removed"] for r in line_dedup.without_repeated_lines(df).collect()} == {k: expected.get(k, []) for k in range(120)}


def labelled(spark, n=240):
    rng = random.Random(6)
    good = [word(rng) + "ly" for _ in range(80)]
    bad, toxic = ["###", "buy!!!", "|", "CLICK"], ["grobnik", "zlodar"]
    docs, labels = [], []
    for k in range(n):
        junk, rude = k % 3 == 0, k % 4 == 1
        words = [rng.choice(bad if junk and rng.random() < 0.6 else good) for _ in range(60)]
        if rude:
            words[rng.randrange(60)] = rng.choice(toxic)
        docs.append((k, " ".join(words)))
        labels.append((k, int(not junk), int(rude)))
    docs += [(n, None), (n + 1, ""), (None, "no id")]
    labels += [(None, 1, 1), (n, None, None)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def held_out_accuracy(found, labels, name, parts, rest):
    truth = {r["doc_id"]: r[name] for r in labels.collect()}
    pairs = [(r["predicted"], truth[r["doc_id"]]) for r in found if truth.get(r["doc_id"]) is not None and zlib.crc32(str(r["doc_id"]).encode()) % parts == rest]
    assert len(pairs) > 20
    return sum(a == b for a, b in pairs) / len(pairs)


def test_quality(spark):
    docs, labels = labelled(spark)
    machine = quality.fit(docs, labels, quality.fold("doc_id", 4) != 2)
    found = quality.scores(docs, machine).collect()
    assert len(found) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in found)
    assert held_out_accuracy(found, labels, "quality", 4, 2) >= 0.95
    assert quality.scores(docs.limit(0), machine).count() == 0


def test_quality_pairs_are_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    n = quality.WORDS + len(quality.structure(b"", [], 0))
    machine = quality.Machine(0.1, rng.normal(size=n), rng.normal(size=(n, 3)), np.zeros(n - quality.WORDS), np.ones(n - quality.WORDS))
    places, x = np.array([1, 7, 9, 20]), rng.normal(size=4)
    v = machine.factors[places]
    pairs = sum(v[a] @ v[b] * x[a] * x[b] for a in range(4) for b in range(a))
    assert machine.margin(places, x)[0] == pytest.approx(0.1 + machine.weights[places] @ x + pairs)


def test_models_without_labels(spark):
    docs, labels = labelled(spark, 12)
    none = labels.limit(0)
    for r in quality.scores(docs, quality.fit(docs, none, quality.fold("doc_id", 4) != 2)).collect():
        assert r["score"] == pytest.approx(0.5)
    for r in toxicity.scores(docs, toxicity.fit(docs, none, toxicity.fold("doc_id", 3) != 1)).collect():
        assert r["score"] == pytest.approx(0.5)
    assert toxicity.fit(docs.limit(0), labels, toxicity.fold("doc_id", 3) != 1).lexicon == {}


def test_toxicity(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels, toxicity.fold("doc_id", 3) != 1)
    found = toxicity.scores(docs, model).collect()
    assert len(found) == docs.count() and all(0 <= r["score"] <= 1 for r in found)
    assert held_out_accuracy(found, labels, "toxic", 3, 1) >= 0.95
    hidden = ["gr0bnik", "grobniiiiik", "g r o b n i k", "g.r.o.b.n.i.k", "zl0d@r", "GROBNIK!!", "(zlodar)"]
    for text in hidden:
        assert model.score(f"andly theer {text} stly") >= 0.7, text
    assert model.score("andly theer stly") < 0.3
    assert toxicity.scores(docs.limit(0), model).count() == 0


def reader(*words):
    """A model that knows these words, with characters counted over them and some others."""
    known = " ".join([*words, "the cat sat on a mat and other plain words of some text"] * 50).encode()
    return toxicity.Model(toxicity.character_costs(toxicity.trigram_counts(known)), {x + "$": 3.0 for x in words})


def hits(model, text):
    return round(float(np.expm1(model.inputs(text)[3])))


def test_toxicity_of_any_length():
    model = reader("worthless", "zed", "counterrevolutionaries")
    w = "worthless"
    long = ["wo" + "r" * 90 + "thless", "-".join(x * 4 for x in w) + "-" * 40, " ".join(x for y in w for x in y * 20), "a b " * 29 + " ".join(w)]
    for text in [*long, "q z e d q", " ".join("counterrevolutionaries")]:
        assert hits(model, f"the cat {text} sat"), text
    assert not hits(model, "the cat " + "a b " * 90 + "sat " + "ab-" * 50)
    assert toxicity.restored("ab1" * 30_000, model.costs)


def test_toxicity_between_marks_doubled_and_in_short_pieces():
    model = reader("stupid", "idiot", "trash", "zed")
    marked = ["you/idiot", "you...idiot", "what-idiot,really", "you!idiot", "(shut)1d1ot", "a:b,stupid;c"]
    doubled = ["iiddiioott", "ttrash", "TTRRAASSHH"]
    spaced = ["st up id", "st-up-id", "5t up 1d", "z e d", "tr ash", "sst tup id", "st, up, id"]
    for text in [*marked, *doubled, *spaced]:
        assert hits(model, f"the cat {text} sat") == 1, text
    assert hits(model, "you/idiot...trash") == 2
    assert not hits(model, "the cat is on a mat, so it is up to us. all letters of it")


@pytest.mark.parametrize(("threshold", "removed"), [(0.6, [1, 2, 4]), (0.75, [1, 2]), (0.8, [])])
def test_line_dedup_of_short_lines(spark, threshold, removed):
    df = spark.createDataFrame([(1, "a b c\na b c d\na b d\nx y\nx y z\nq")], "doc_id long, text string")
    assert line_dedup.without_repeated_lines(df, threshold=threshold).first()["removed"] == removed
