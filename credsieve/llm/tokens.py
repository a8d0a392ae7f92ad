"""Token counts and ids of whole texts by a public tokenizer file.

Method: *overlap resynchronisation*.  A huge text is cut into chunks that overlap; each chunk is
encoded on its own, with the offset of every token, and neighbouring encodings are spliced at a
boundary that both have and that is proven stable.  The proof, for the byte-level scanner: one white
space character between two others that are not white space always begins a pre-token, whatever
stands around it, as no pre-token holds white space behind its first character unless it is white
space throughout.  From such a place on the scanner reads the same characters in the same state in
either chunk and in the whole text, so the ids are those of the whole text.  Where an overlap holds
no such place (one very long run, for instance) it is doubled, up to the rest of the text.

Tokenizers come from a path: `.json` files are read by `tokenizers`, `.model` files by
`sentencepiece`.  Where the merges of a `.json` file are in the order of their ids, the same merges
run in `tiktoken`, which is faster; characters outside its known range stay with `tokenizers`.
Special strings in a text are treated as the library treats them by default; none are added;
nothing is truncated or padded.  Files of another kind than byte-level are encoded text by text.

Null texts count as empty, empty texts have zero tokens.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credsieve.llm.common import plain_text, ship_package

#: Characters of a chunk and of the first overlap; texts up to CHUNK are encoded at once.
CHUNK, OVERLAP = 1 << 15, 1 << 9
#: One white space character between two others: here a pre-token begins in any scan.
_STABLE = re.compile(r"(?<=\S)\s(?=\S)")
#: Up to here both libraries are known to class characters alike (four control characters are odd).
_FAMILIAR = re.compile("[\x00-\x1b\x20-\u024f]*")


def _byte_letters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for
    itself, the others in order from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [x for x in range(256) if x not in shown]
    return {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(hidden)}


@dataclass
class Encoder:
    """Ids of whole texts, as bytes; equal to the library's own result for every text."""

    path: str

    def __post_init__(self) -> None:
        if self.path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=self.path)
            self._plain = lambda text: model.encode(text, num_threads=1)
            self.by_piece, self.specials = False, []
            return
        with open(self.path, encoding="utf-8") as source:
            said = json.load(source)
        scanner = said.get("pre_tokenizer") or {}
        added = said.get("added_tokens") or []
        self._library = None
        # Only for this scanner is it proven above that words can be encoded one by one.
        self.by_piece = (
            said.get("normalizer") is None
            and scanner.get("type") == "ByteLevel"
            and scanner.get("use_regex", True)
            and not scanner.get("add_prefix_space", True)
            and not any(a.get("lstrip") or a.get("rstrip") or a.get("single_word") for a in added)
        )
        self.ids_of_specials = {a["content"]: a["id"] for a in added}
        self.specials = sorted(self.ids_of_specials, key=len, reverse=True)
        self._split = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None
        if self.by_piece:
            self._word = self._faster(said) or self._plain
            widths = {k: len(x) for x, k in said["model"]["vocab"].items()}
            self.widths = np.array([widths.get(k, 0) for k in range(max(widths) + 1)])

    def _plain(self, text: str) -> list[int]:
        """By the library of the file's kind; loaded when first needed, as most texts never need it."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
            self._library.no_truncation()
            self._library.no_padding()
        return self._library.encode(text, add_special_tokens=False).ids

    def _faster(self, said: dict) -> Callable[[str], list[int]] | None:
        """The same merges in the quicker library, where ids are in the order of merging."""
        import tiktoken

        letters, vocabulary, merges = _byte_letters(), said["model"]["vocab"], said["model"]["merges"]
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in merges]
        if [vocabulary.get(a + b) for a, b in pairs] != list(range(256, 256 + len(pairs))):
            return None
        ranks = {bytes(map(letters.__getitem__, x)): k for x, k in vocabulary.items() if x not in self.specials}
        pattern = (
            r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # the scanner's fixed rule
        )
        quick = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        plain, familiar = self._plain, _FAMILIAR.fullmatch
        return lambda text: quick.encode_ordinary(text) if familiar(text) else plain(text)

    def ids(self, text: str) -> bytes:
        """Ids of the whole text as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if not self.by_piece:
            return np.asarray(self._plain(text), dtype="<u4").tobytes()
        if self._split and any(x in text for x in self.specials):
            return b"".join(
                np.array([self.ids_of_specials[x]], dtype="<u4").tobytes() if k % 2 else self._ordinary(x)
                for k, x in enumerate(self._split.split(text))
                if x
            )
        return self._ordinary(text)

    def _ordinary(self, text: str) -> bytes:
        if len(text) <= CHUNK:
            return np.asarray(self._word(text), dtype="<u4").tobytes()
        return b"".join(resynchronised(text, self._with_offsets, CHUNK, OVERLAP))

    def _with_offsets(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and the byte at which each token begins, and the end."""
        ids = np.asarray(self._word(text), dtype="<u4")
        return ids, np.concatenate(([0], np.cumsum(self.widths[ids])))


def resynchronised(
    text: str, encode: Callable[[str], tuple[np.ndarray, np.ndarray]], chunk: int, overlap: int
) -> Iterator[bytes]:
    """Encodings of the parts of `text`, to be joined; memory is bounded by a chunk and its overlap."""

    def encoded(begin: int, width: int) -> tuple[int, int, np.ndarray, np.ndarray]:
        stop = min(len(text), begin + chunk + width)
        return begin, stop, *encode(text[begin:stop])

    def place(part: tuple, at: int) -> int | None:
        """The token of this part that begins at the character `at`, or None."""
        byte = len(text[part[0] : at].encode())
        k = int(np.searchsorted(part[3], byte))
        return k if k < len(part[3]) and part[3][k] == byte else None

    left, first = encoded(0, overlap), 0
    while left[1] < len(text):
        width, right = overlap, encoded(left[0] + chunk, overlap)
        while True:
            # The last two characters may have been read otherwise because of the cut behind them.
            inside = _STABLE.finditer(text, right[0] + 1, min(left[1], right[1]) - 1)
            cut = next(((a, b) for x in inside if (a := place(left, x.start())) and (b := place(right, x.start()))), None)
            if cut or left[1] == len(text):
                break
            width *= 2  # no common boundary: widen and encode again
            left, right = encoded(left[0], width), encoded(right[0], width)
        if not cut:
            break
        yield left[2][first : cut[0]].tobytes()
        left, first = right, cut[1]
    yield left[2][first:].tobytes()


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each tokenizer file and Python worker."""
    return Encoder(path)


def strings(column: pa.ChunkedArray | pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def token_counts(
    docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """`id_col`, n_bytes (UTF-8), n_tokens and over_limit (more than `limit`) of every row of `docs`.

    Runs beside the scan without a shuffle: only the id and the text reach Python, in Arrow batches.
    """
    ship_package(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        for batch in batches:
            texts = strings(batch.column(1))
            tokens = [len(tool.ids(x)) // 4 for x in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x.encode()) for x in texts], pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array([x > limit for x in tokens], pa.bool_()),
                ],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(F.col(id_col), plain_text(docs, text_col).alias("text"))
    schema = T.StructType(
        [
            T.StructField(id_col, rows.schema[0].dataType),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("over_limit", T.BooleanType()),
        ]
    )
    return rows.mapInArrow(count, schema)
