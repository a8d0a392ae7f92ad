"""Which lines of a batch of texts can hold a finding: a few passes over all bytes at once.

Every line on which a stage of the scanner starts a finding passes (and few others do): it has a run of
token characters that is long enough for the sweep, for encoded text and for most provider patterns; or
a keyword of another pattern; or a credential name beside a sign; or an address with a login; or a login
call; or escapes.  Which patterns a long run covers follows from the patterns themselves, so rules of a
configuration are screened like those of the catalog; a rule without keywords that no run covers passes
all lines.  Texts are joined by line ends, so a batch costs the same few passes however many it holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

from credsieve.operators.scanner import is_credential_file
from credsieve.plans import values as V
from credsieve.plans.config import Config

try:
    from re import _constants as K
    from re import _parser as parser
except ImportError:  # before 3.11
    import sre_constants as K
    import sre_parse as parser

RUN, BLOCK = 16, 1 << 20
_RUN = np.zeros(256, bool)
_RUN[[*b"0123456789+/_-", *range(65, 91), *range(97, 123)]] = True
#: Names of login calls, as V.LOGIN_CALL has them.
LOGINS = tuple(a + x + b for a, b in (("log", "in"), ("log", "on"), ("sign", "in"), ("basic", "auth"), ("set", "credentials")) for x in ("", "_")) + ("authenticate",)


def sure_run(pattern: str) -> int:
    """Characters of a run of token characters that every match of `pattern` has, at least."""
    return max(_runs(parser.parse(pattern, re.ASCII), 0))


def _runs(nodes: object, now: int) -> tuple[int, int]:
    """(longest run so far, the run at the end) behind these nodes, for `now` characters before them."""
    best = now
    for op, given in nodes:
        if op is K.LITERAL:
            now = now + 1 if given < 256 and _RUN[given] else 0
        elif op is K.IN:
            now = now + 1 if _all_in_run(given) else 0
        elif op is K.SUBPATTERN:
            inner, now = _runs(given[-1], now)
            best = max(best, inner)
        elif op is K.BRANCH:
            ends = [_runs(x, now) for x in given[1]]
            best = max(best, min(x[0] for x in ends))
            now = min(x[1] for x in ends) if all(_within_run(x) for x in given[1]) else 0
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT):
            least, _, inner = given
            if _within_run(inner):
                now += least * _runs(inner, 0)[1]
            else:
                best = max(best, _runs(inner, 0)[0] if least else 0)
                now = 0
        elif op not in (K.AT, K.ASSERT, K.ASSERT_NOT):
            now = 0
        best = max(best, now)
    return best, now


def _within_run(nodes: object) -> bool:
    """Whether all that these nodes match are token characters."""
    return all(
        (op is K.LITERAL and given < 256 and bool(_RUN[given]))
        or (op is K.IN and _all_in_run(given))
        or (op is K.SUBPATTERN and _within_run(given[-1]))
        or (op is K.BRANCH and all(_within_run(x) for x in given[1]))
        or (op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT) and _within_run(given[2]))
        for op, given in nodes
    )


def _all_in_run(members: list) -> bool:
    for op, given in members:
        if op is K.LITERAL:
            low = high = given
        elif op is K.RANGE:
            low, high = given
        elif op is K.CATEGORY and given in (K.CATEGORY_DIGIT, K.CATEGORY_WORD):
            continue
        else:
            return False
        if high > 255 or not _RUN[low : high + 1].all():
            return False
    return True


class Screen:
    """The screen of a configuration."""

    def __init__(self, config: Config):
        open_rules = [r for r in config.active_rules() if sure_run(r.pattern) < RUN]
        self.all = any(not r.keywords for r in open_rules)
        self.decodes = config.scan.max_decode_depth > 0
        self.keywords = _shortest({k.lower() for r in open_rules for k in r.keywords})

    def rows(self, paths: list[str], texts: list[bytes]) -> Iterator[tuple[int, list[int] | None]]:
        """(place, lines from 0) of the texts that have lines to scan; None stands for all lines."""
        first = 0
        while first < len(texts):
            stop, size = first, 0
            while stop < len(texts) and (stop == first or size + len(texts[stop]) < BLOCK):
                size += len(texts[stop]) + 1
                stop += 1
            part = texts[first:stop]
            found = {} if self.all else self._passed(part)
            for k, path in enumerate(paths[first:stop]):
                if self.all or is_credential_file(path):
                    yield first + k, None
                elif k in found:
                    yield first + k, found[k]
            first = stop

    def _passed(self, texts: list[bytes]) -> dict[int, list[int]]:
        data = b"\n".join(texts)
        low, letters = data.lower(), np.frombuffer(data, np.uint8)
        breaks = np.flatnonzero(letters == 10)
        starts = np.concatenate(([0], breaks + 1))
        hits: list[int] = []

        def each(word: bytes) -> Iterator[tuple[int, int]]:
            """The line (its start and end) of every first occurrence on a line."""
            at = low.find(word)
            while at >= 0:
                begin, end = low.rfind(b"\n", 0, at) + 1, low.find(b"\n", at)
                end = len(low) if end < 0 else end
                yield begin, end
                at = low.find(word, end)

        for word in self.keywords:
            hits.extend(a for a, _ in each(word))
        for word in V.CREDENTIAL_WORDS:
            for a, b in each(word.encode()):
                line = low[a:b]
                if any(x in line for x in (b"=", b":", b",", b"<", b"passw", b"passphrase")):
                    hits.append(a)
        hits.extend(a for a, b in each(b"://") if low.find(b"@", a, b) >= 0)
        if b"(" in low:
            for word in LOGINS:
                hits.extend(a for a, b in each(word.encode()) if low.find(b"(", a, b) >= 0)
        if self.decodes:
            hits.extend(a for a, b in each(b"%") if low.count(b"%", a, b) > 1)
            hits.extend(a for a, _ in each(b"\\u"))
        token = _RUN[letters]
        edges = np.flatnonzero(token[1:] != token[:-1]) + 1
        edges = np.concatenate(([0] if len(token) and token[0] else [], edges, [len(token)] if len(token) and token[-1] else [])).astype(np.int64)
        long = edges[::2][np.diff(edges.reshape(-1, 2), axis=1).ravel() >= RUN]
        lines = np.unique(np.searchsorted(starts, np.concatenate((np.array(hits, np.int64), long)), side="right") - 1)
        ends = np.cumsum([x.count(b"\n") + 1 for x in texts])
        owner = np.searchsorted(ends, lines, side="right")
        found: dict[int, list[int]] = {}
        for k, line in zip(owner.tolist(), (lines - np.concatenate(([0], ends))[owner]).tolist(), strict=True):
            found.setdefault(k, []).append(line)
        return found


def _shortest(words: set[str]) -> list[bytes]:
    """Words, without those that hold another one."""
    return [w.encode() for w in sorted(words) if not any(x != w and x in w for x in words)]
