"""BPE encoding as a bounded-lookahead streaming transducer, decoding as a byte-to-text state machine.

Input columns ``doc_id`` and ``text``; others are ignored. A null or empty text has no tokens and
decodes to the empty text; repeated rows each give a row; an empty table gives no rows; a null
``doc_id`` stays null. Memory is bounded by the window, not by a text: a text is read in chunks, and a
pre-token longer than a window (one endless word) is itself cut where the merge list's lookahead
proves that the tokens before the cut can no longer change.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidelog.llm._shared import from_lists, resident, ship

#: Pre-token pattern of the byte-level vocabularies (a fixed value, public).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points read at a time; longest pre-token encoded at once; remembered pieces.
CHUNK, LONG, CACHE = 1 << 16, 512, 240_000
#: Marks that are one pre-token after letters; the rank of no merge.
MARKS, NONE = ".,;:!?", 1 << 60
#: A pre-token's choice reads at most so many code points beyond its end.
PEEK = 3


def byte_alphabet() -> dict[int, str]:
    """The printable character for each byte in byte-level vocabularies: printable ones stand for
    themselves, the others follow from code point 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Transducer:
    """Encoder and decoder of one byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = {c: b for b, c in byte_alphabet().items()}
        raw = lambda s: bytes(to_byte[c] for c in s)
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items() if all(c in to_byte for c in t)}
        pairs = [p if isinstance(p, list) else p.split(" ") for p in spec["model"]["merges"]]
        merges = [(raw(a), raw(b)) for a, b in pairs]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {t: i for t, i in self.ids.items() if i not in set(self.special.values())}
        self.bytes_of = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.lookahead = sufficient_lookahead(merges)
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        self.pair_ranks = {self.ids[a] << 20 | self.ids[b]: r for r, (a, b) in enumerate(merges)}
        self.made = [self.ids[a + b] for a, b in merges]
        self.split = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # Two generations of each memory: when one is full it takes the place of the older one.
        self.known: dict[str, bytes] = {}
        self.old_known: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}
        self.old_runs: dict[str, bytes] = {}
        self.mark_ids = {c: array("I", self.merge(c.encode())).tobytes() for c in MARKS}

    def merge(self, token: bytes) -> list[int]:
        """Ids after the merges, lowest rank first, leftmost first; only ranks beside a merge change."""
        ranks, made = self.pair_ranks, self.made
        ids = [self.byte_ids[b] for b in token]
        if len(ids) > 64:  # all places of the lowest pair in one pass; what a merge makes only ranks higher
            while pairs := [(r, a, b) for a, b in zip(ids, ids[1:]) if (r := ranks.get(a << 20 | b)) is not None]:  # noqa: B905
                best, left, right = min(pairs)
                out, i = [], 0
                while i < len(ids):
                    if ids[i] == left and i + 1 < len(ids) and ids[i + 1] == right:
                        out.append(made[best])
                        i += 2
                    else:
                        out.append(ids[i])
                        i += 1
                ids = out
            return ids
        of = [ranks.get(a << 20 | b, NONE) for a, b in zip(ids, ids[1:])]  # noqa: B905
        while of:
            best = min(of)
            if best == NONE:
                break
            i = of.index(best)
            ids[i : i + 2] = [made[best]]
            del of[i]
            if i:
                of[i - 1] = ranks.get(ids[i - 1] << 20 | ids[i], NONE)
            if i < len(of):
                of[i] = ranks.get(ids[i] << 20 | ids[i + 1], NONE)
        return ids

    def long_token(self, pieces: Iterator[bytes]) -> Iterator[int]:
        """Ids of one endless pre-token given piece by piece: a token is emitted once it ends at least
        the sufficient lookahead before what is known, for nothing after that can change it."""
        held = b""
        for piece in pieces:
            held += piece
            if len(held) < LONG + 2 * self.lookahead:
                continue
            done = 0
            for t in self.merge(held):
                if done + len(self.bytes_of[t]) > len(held) - self.lookahead:
                    break
                yield t
                done += len(self.bytes_of[t])
            held = held[done:]
        yield from self.merge(held)

    def token_ids(self, token: str) -> bytes:
        """Ids of one pre-token as little-endian 32-bit integers."""
        raw = token.encode()
        got = self.long_token(raw[i : i + LONG] for i in range(0, len(raw), LONG)) if len(raw) > LONG else self.merge(raw)
        return array("I", got).tobytes()

    def _remembered(self, key: str) -> bytes:
        got = self.old_known.get(key) or self.token_ids(key)
        if len(self.known) >= CACHE // 8:
            self.old_known, self.known = self.known, {}
        if len(key) <= 64:
            self.known[key] = got
        return got

    def _span(self, text: str) -> Iterator[bytes]:
        """Ids of text without special strings, by chunks; only pre-tokens that no later code point
        can change leave a chunk, the rest waits for the next one."""
        held, at = "", 0
        while at < len(text) or held:
            chunk = text[at : at + CHUNK]
            at += len(chunk)
            held += chunk
            last = at >= len(text)
            if not last and len(held) > CHUNK + LONG and (m := self.split.match(held)) and m.end() == len(held):
                # One pre-token larger than a window: hand it to the transducer piece by piece.
                end = self.split.match(text, at - len(held)).end()
                start = at - len(held)
                yield from (i.to_bytes(4, "little") for i in self.long_token(text[i : min(i + LONG, end)].encode() for i in range(start, end, LONG)))
                held, at = "", end
                continue
            out, done = [], 0
            for m in self.split.finditer(held):
                if not last and m.end() > len(held) - PEEK:
                    break
                token, done = m[0], m.end()
                got = self.known.get(token)
                out.append(got if got is not None else self._remembered(token))
            held = held[done:]
            yield b"".join(out)
            if last:
                break

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids of a whole text as little-endian 32-bit integers, in pieces, in order."""
        parts = self.cut.split(text) if self.cut and "<|" in text else [text]
        for k, part in enumerate(parts):
            if k % 2:
                yield self.special[part].to_bytes(4, "little")
            elif part:
                yield from self._runs(part)

    def _runs(self, text: str) -> Iterator[bytes]:
        """Ids by windows that end where a space follows other text, as no pre-token reaches over that."""
        start = 0
        while start < len(text):
            end = len(text) if len(text) - start <= CHUNK else text.find(" ", start + CHUNK)
            while 0 <= end < len(text) and text[end - 1].isspace():
                end = text.find(" ", end + 1)
            end = len(text) if end < 0 else end
            got = self._window(text[start:end], start == 0) if end - start <= 2 * CHUNK else None
            if got is None:
                yield from self._span(text[start:end])
            else:
                yield got
            start = end

    def _window(self, window: str, first: bool) -> bytes | None:
        head, *rest = window.split(" ")
        if head and (head[-1].isspace() and rest or not first):
            return None
        get, out = self.runs.get, [b"".join(self._span(head))] if head else []
        for p in rest:
            x = get(p)
            if x is None:
                if not p or p[0].isspace() or p[-1].isspace():
                    return None
                # Letters and one mark after them are two pre-tokens.
                if p[-1] in MARKS and p[:-1].isalpha():
                    x = (get(p[:-1]) or self._run(p[:-1])) + self.mark_ids[p[-1]]
                else:
                    x = self._run(p)
            out.append(x)
        return b"".join(out)

    def _run(self, run: str) -> bytes:
        """Ids of a run without spaces, with the space before it; remembered while there is room."""
        x = self.runs.get(run)
        if x is None:
            x = self.old_runs.get(run)
        if x is None:
            x = self.token_ids(" " + run) if run.isalpha() else b"".join(self._span(" " + run))
        if len(run) <= 64:
            if len(self.runs) >= CACHE // 2:
                self.old_runs, self.runs = self.runs, {}
            self.runs[run] = x
        return x

    def decode(self, ids: bytes) -> Iterator[str]:
        """Text of little-endian 32-bit ids, as soon as whole characters are known: bytes that end inside
        a character wait in the state, and what can't be one becomes U+FFFD."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        of = self.bytes_of
        view = memoryview(ids).cast("I")
        for i in range(0, len(view), CHUNK):
            yield state.decode(b"".join([of.get(x, b"") for x in view[i : i + CHUNK]]))
        yield state.decode(b"", True)


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes to the right of a token that can still change it.

    A merge is undone from the right only by a merge of lower rank that takes its last symbol, or the
    last symbol of one of its parts while that part is made; that merge's right part in turn depends
    only on merges of still lower rank. Ranks fall along the chain, so its longest reach is found in
    one pass over the merges in rank order.
    """
    reach: dict[bytes, int] = {}  # by left symbol, over the merges seen so far
    spine: dict[bytes, int] = {}  # of a merged symbol: the reach of its right parts when it was made
    most = 0
    for left, right in merges:
        far = len(right) + max(reach.get(right, 0), spine.get(right, 0))
        spine[left + right] = max(spine.get(left + right, 0), reach.get(right, 0), spine.get(right, 0))
        reach[left] = max(reach.get(left, 0), far)
        most = max(most, far)
    return most + max((len(a) + len(b) for a, b in merges), default=1)


def transducer(path: str) -> Transducer:
    return resident(Transducer, path)


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode_decode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Encode each text, decode the ids again, and return digests of both."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(vocabulary)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids_hash, text_hash, n = hashlib.sha256(), hashlib.sha256(), 0
                state = codecs.getincrementaldecoder("utf-8")("replace")
                for ids in t.encode(text.as_py() or ""):
                    ids_hash.update(ids)
                    n += len(ids) // 4
                    of = t.bytes_of
                    text_hash.update(state.decode(b"".join([of[x] for x in memoryview(ids).cast("I")])).encode())
                text_hash.update(state.decode(b"", True).encode())
                rows.append((doc, n, ids_hash.hexdigest(), text_hash.hexdigest()))
            yield from_lists(_ARROW, rows)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
