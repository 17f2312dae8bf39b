"""Byte-pair encoding as a streaming transducer with bounded lookahead, and decoding by a state machine.

Encoding reads text in pieces of any size. Text is cut where a token can't cross: before a space between two other
characters, and at the borders of the pre-tokenizer's matches. Within a match, bytes are held until the merge list's
*sufficient lookahead* lies behind them; tokens that end before it are final and leave. So the state is bounded by
that lookahead, however long a text, a word or a run of spaces is.

The sufficient lookahead follows from the merge list in one pass in rank order. Whether merge r = (u, v) happens where
u and v meet depends on bytes behind v only if v was formed there, or if an earlier merge (v, y) takes v away; so

    look(r) = max(look(merge that makes v), max over earlier r' = (v, y) of |y| + look(r')),

and a token is final once the largest |y| + look(r') over all merges (token, y) lies behind it.

Decoding maps ids to bytes and bytes to text with an incremental UTF-8 machine that holds at most three bytes.

Units of text that were seen before are looked up in a bounded cache; the cache changes no result. encode() and the
query run the transducer too: a text is fed in pieces of `PIECE` characters.
"""

from __future__ import annotations

import codecs
import heapq
import json
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlake.llm.common import table, trimming

#: Pre-tokenizer of byte-level vocabularies: a fixed value.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: What a match of the pattern goes on with, by the class of its last character.
_GOES_ON = [regex.compile(x) for x in (r"\p{L}*", r"\p{N}*", r"[^\s\p{L}\p{N}]*")]
_SPACE = regex.compile(r"\s*")
#: Characters held before a match without an end is streamed, and units kept in a cache.
HOLD, CACHE = 1 << 12, 1 << 17
#: Characters of a text fed at once.
PIECE = 1 << 16
#: Characters behind the end of a match that may still change it: a contraction is one match with its apostrophe.
_BEHIND = 3


def byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    out.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))})
    return out


class Vocabulary:
    """Merges, token bytes and special strings of a byte-level BPE file, and its sufficient lookahead."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars, ids = byte_chars(), spec["model"]["vocab"]
        raw = lambda s: bytes(chars[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = [b""] * (1 + max([*ids.values(), *self.special.values()]))
        for s, i in ids.items():
            self.bytes_of[i] = raw(s)
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        self.single = [0] * 256
        for c, b in chars.items():
            self.single[b] = ids[c]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merges.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
        self.rank = {a << 32 | b: r for (a, b), (r, _) in self.merges.items()}
        self.made = [0] * len(spec["model"]["merges"])
        for r, w in self.merges.values():
            self.made[r] = w
        self.lookahead = self._sufficient_lookahead()
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _sufficient_lookahead(self) -> int:
        taken: dict[int, int] = {}  # token -> most bytes behind it that merges so far, with it on their left, depend on
        formed: dict[int, int] = {}  # token -> lookahead of the merges that make it
        for (u, v), (_, w) in sorted(self.merges.items(), key=lambda x: x[1][0]):
            look = max(formed.get(v, 0), taken.get(v, 0))
            formed[w] = max(formed.get(w, 0), look)
            taken[u] = max(taken.get(u, 0), len(self.bytes_of[v]) + look)
        return max([0, *taken.values(), *formed.values()])

    def merge(self, data: bytes) -> list[int]:
        """Tokens of a whole piece: the pair of least rank first, from the left."""
        ids = [self.single[b] for b in data]
        if len(ids) > 48:
            return self._merge_heap(ids)
        rank, made, none = self.rank.get, self.made, len(self.made)
        ranks = [rank(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks:
            r = min(ranks)
            if r == none:
                break
            i = ranks.index(r)
            ids[i : i + 2] = [made[r]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank(ids[i] << 32 | ids[i + 1], none)
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 32 | ids[i], none)
        return ids

    def _merge_heap(self, ids: list[int]) -> list[int]:
        merges, n = self.merges, len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        gone = [False] * n
        while heap:
            _, i, a, b, w = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], gone[j] = w, True
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if m := merges.get((w, ids[k])):
                    heapq.heappush(heap, (m[0], i, w, ids[k], m[1]))
            if (p := before[i]) >= 0 and (m := merges.get((ids[p], w))):
                heapq.heappush(heap, (m[0], p, ids[p], w, m[1]))
        return [x for x, dead in zip(ids, gone, strict=True) if not dead]


_STOPS = (".", ",")


class _Odd(Exception):
    """White space beside a space: the text can't be cut at every space."""


class _Core:
    """Tokens of one match whose bytes come in pieces."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.held = vocab, b""
        self.full = max(HOLD, 4 * vocab.lookahead)

    def feed(self, data: bytes) -> Iterator[int]:
        for at in range(0, len(data), self.full):
            self.held += data[at : at + self.full]
            if len(self.held) >= self.full:
                end, stable = 0, len(self.held) - self.vocab.lookahead
                for t in self.vocab.merge(self.held):
                    if end + len(self.vocab.bytes_of[t]) > stable:
                        break
                    end += len(self.vocab.bytes_of[t])
                    yield t
                self.held = self.held[end:]

    def finish(self) -> Iterator[int]:
        yield from self.vocab.merge(self.held)
        self.held = b""


class Cache(dict):
    """A dict of made values, of two generations: it holds twice `size` entries at most."""

    def __init__(self, make, size: int = CACHE):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) < 256:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value


class _Words(Cache):
    """Parts of text; a word before a stop is made from the word itself, and would only take its place."""

    def __missing__(self, key):
        if key[-1:] in _STOPS and key[1:-1].isalpha():
            return self.make(key)
        return super().__missing__(key)


class Encoder:
    """Text to token ids; feed() takes pieces of a text, finish() ends it. ids come as bytes of little-endian uint32."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self._matches = Cache(self._match)
        self._units = Cache(self._unit)
        self._spaced = _Words(self._spaced_unit)
        self.longest = max(map(len, vocab.special), default=0)
        self._reset()

    def _reset(self) -> None:
        self.text, self.core, self.goes_on, self.pending = "", None, None, ""

    def _match(self, m: str) -> bytes:
        ids = self.vocab.merge(m.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def _unit(self, unit: str) -> bytes:
        if len(unit) <= 64 and (unit[0] == " " or unit[0].isalpha()):
            if unit[1:].isalpha() or len(unit) == 1 and unit != " ":
                return self._match(unit)
            if unit[-1] in ".," and unit[1:-1].isalpha():
                word = self._spaced[unit[1:-1]] if unit[0] == " " else self._match(unit[:-1])
                return word + self._matches[unit[-1]]
        return b"".join(self._plain(unit))

    def _spaced_unit(self, part: str) -> bytes:
        if not part or part[0].isspace() or part[-1].isspace():
            raise _Odd
        return self._unit(" " + part)

    def _plain(self, text: str) -> Iterator[bytes]:
        """Tokens of text that no match crosses the ends of."""
        if self.vocab.split_special and any(s in text for s in self.vocab.special):
            for i, x in enumerate(self.vocab.split_special.split(text)):
                if i % 2:
                    yield np.array([self.vocab.special[x]], "<u4").tobytes()
                elif x:
                    yield from self._plain(x)
            return
        for m in PATTERN.finditer(text):
            piece = m.group()
            if len(piece) <= 64:
                yield self._matches[piece]
            else:
                core = _Core(self.vocab)
                for at in range(0, len(piece), HOLD):
                    yield np.fromiter(core.feed(piece[at : at + HOLD].encode()), "<u4").tobytes()
                yield np.fromiter(core.finish(), "<u4").tobytes()

    def units(self, text: str) -> Iterator[bytes]:
        """Tokens of text whose ends no match crosses, unit by unit."""
        if not text:
            return
        lead, held = "", None
        for p in text.split(" "):
            if held is not None:
                held += " " + p
                if not p or p[0].isspace() or p[-1].isspace():
                    continue
                yield from self._plain(held)
                held = None
            elif p and not p[0].isspace() and not p[-1].isspace() and len(p) < 256:
                yield self._spaced[p] if lead else self._units[p]
            elif p and not p[0].isspace() and not p[-1].isspace():
                yield from self._plain(lead + p)
            else:
                held = lead + p
            lead = " "
        if held is not None:
            yield from self._plain(held)

    def feed(self, piece: str) -> Iterator[bytes]:
        """Tokens that are final once `piece` is read."""
        if self.goes_on is not None:
            piece = yield from self._go_on(self.pending + piece)
        self.text += piece
        if (cut := self._last_cut()) > 0:
            yield from self._cut_units(self.text[:cut])
            self.text = self.text[cut:]
        while len(self.text) > HOLD + self.longest and self.goes_on is None:
            stop, whole = self._stop(self.text)
            if whole:
                end = self.vocab.split_special.match(self.text, stop).end()
                yield from self._plain(self.text[:end])
                self.text = self.text[end:]
                continue
            held, self.text = self.text[stop:], self.text[:stop]
            yield from self._open()
            if self.goes_on is None:
                self.text += held
                break
            self.pending = held

    def _last_cut(self) -> int:
        """The last place where no match crosses: before a space between two characters that are not white space."""
        at = self.text.rfind(" ", 0, len(self.text) - 1)
        while at > 0 and (self.text[at - 1].isspace() or self.text[at + 1].isspace()):
            at = self.text.rfind(" ", 0, at)
        return at

    def _cut_units(self, text: str) -> Iterator[bytes]:
        """units(), in one go where every space is a cut."""
        first, *rest = text.split(" ")
        if not first and rest:
            first = " " + rest.pop(0)
        try:
            if not first.strip() or first[-1].isspace() or first[1:2].isspace() or first[0].isspace() and first[0] != " ":
                raise _Odd
            yield self._units[first] + b"".join(map(self._spaced.__getitem__, rest))
        except _Odd:
            yield from self.units(text)

    def _stop(self, piece: str) -> tuple[int, bool]:
        """Where a special string begins in `piece` or may begin at its end; whether it is whole there."""
        whole = min((i for s in self.vocab.special if (i := piece.find(s)) >= 0), default=len(piece))
        for s in self.vocab.special:
            for n in range(min(len(s) - 1, len(piece)), 0, -1):
                if piece.endswith(s[:n]) and len(piece) - n < whole:
                    return len(piece) - n, False
        return whole, whole < len(piece)

    def _open(self) -> Iterator[bytes]:
        """The held text has no cut: its matches that nothing behind it can change are final, and a long last one is streamed."""
        at, last = 0, ""
        for m in PATTERN.finditer(self.text):
            last = m.group()
            if m.end() > len(self.text) - _BEHIND:
                break
            yield self._matches[last] if len(last) <= 64 else np.array(self.vocab.merge(last.encode()), "<u4").tobytes()
            at = m.end()
        self.text = self.text[at:]
        if len(last) <= HOLD or len(last) < len(self.text):
            return
        self.core = _Core(self.vocab)
        if last[-1].isspace():
            self.goes_on, self.text, body = _SPACE, last[-1], last[:-1]
        else:
            self.goes_on = next(p for p in _GOES_ON if p.fullmatch(last[-1]))
            self.text, body = "", last
        yield np.fromiter(self.core.feed(body.encode()), "<u4").tobytes()

    def _go_on(self, piece: str):
        """Feeds the open match; returns what comes behind it."""
        self.pending = ""
        stop, whole = self._stop(piece)
        own = self.goes_on.match(piece, 0, stop).group()
        body = self.text + own
        self.text = ""
        at_special = whole and len(own) == stop
        if self.goes_on is _SPACE and body and not at_special:  # the last space stays: it may belong to what follows
            self.text, body = body[-1], body[:-1]
        yield np.fromiter(self.core.feed(body.encode()), "<u4").tobytes()
        if len(own) == stop and not whole:
            self.pending = piece[stop:]  # nothing, or the begin of a special string
            return ""
        yield np.fromiter(self.core.finish(), "<u4").tobytes()
        self.core = self.goes_on = None
        return piece[len(own) :]

    def finish(self) -> Iterator[bytes]:
        if self.goes_on is not None and self.pending:  # no special string after all
            own = self.goes_on.match(self.pending).group()
            if self.goes_on is not _SPACE:
                yield np.fromiter(self.core.feed(own.encode()), "<u4").tobytes()
                self.pending = self.pending[len(own) :]
            yield np.fromiter(self.core.finish(), "<u4").tobytes()
            yield from self.units(self.text + self.pending)
        elif self.goes_on is not None:
            yield np.fromiter(self.core.feed(self.text.encode()), "<u4").tobytes()
            yield np.fromiter(self.core.finish(), "<u4").tobytes()
        else:
            yield from self._cut_units(self.text)
        self._reset()

    def encode(self, text: str) -> bytes:
        """All ids of a text that is in memory: feed() over its pieces, and finish()."""
        out: list[bytes] = []
        for at in range(0, len(text), PIECE):
            out += self.feed(text[at : at + PIECE])
        out += self.finish()
        return b"".join(out)


class Decoder:
    """Token ids to text, incrementally; bytes that are not UTF-8 become U+FFFD."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self._machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self._machine.decode(b"".join(map(self.vocab.bytes_of.__getitem__, ids)))

    def finish(self) -> str:
        out = self._machine.decode(b"", True)
        self._machine.reset()
        return out

    def decode(self, ids: np.ndarray) -> str:
        return "".join(self.feed(ids[at : at + 65536].tolist()) for at in range(0, len(ids), 65536)) + self.finish()


_made: dict = {}


def coder(path: str) -> tuple[Encoder, Decoder]:
    """One of each for a Python worker; their caches live as long as it does."""
    if path not in _made:
        vocab = Vocabulary(path)
        _made[path] = Encoder(vocab), Decoder(vocab)
    return _made[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _lists(parts: list[bytes]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(p) // 4 for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def _batches(batches, at: int, path: str, ids: str, decoded: str | None):
    """Batches with the ids (and, read from them, the decoded text) of the texts in column `at`."""
    encoder, decoder = coder(path)
    for b in batches:
        # whole batches of long texts could hold many tokens: each output batch is bounded
        start, size, parts = 0, 0, []
        for i, t in enumerate(b.column(at)):
            parts.append(encoder.encode(t.as_py() or ""))
            size += len(parts[-1])
            if size > 1 << 22 or i == b.num_rows - 1:
                part, names = b.slice(start, i + 1 - start), [*b.schema.names, ids]
                made = [_lists(parts)]
                if decoded is not None:
                    made.append(pa.array([decoder.decode(np.frombuffer(p, "<u4")) for p in parts], pa.string()))
                    names.append(decoded)
                yield pa.record_batch([*part.columns, *made], names=names)
                start, size, parts = i + 1, 0, []


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """`docs` with the token ids of each text (array<int>); a null text counts as empty.

    With `decoded` the ids are decoded in the same pass, to a column of that name. Columns `ids` and `decoded` are
    replaced if `docs` has them; all others stay, whatever they are named or hold. Rows are never regrouped, so repeated
    rows stay and an empty table gives an empty one.
    """
    docs = docs.drop(ids, *([decoded] if decoded else []))
    at = docs.columns.index(text)

    def run(batches):
        from driftlake.llm import bpe

        yield from bpe._batches(batches, at, path, "ids", "decoded" if decoded else None)

    from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

    names = [*docs.columns, ids, *([decoded] if decoded else [])]
    plain = docs.withColumn(text, F.col(f"`{text}`").cast("string")).toDF(*[f"c{i}" for i in range(len(docs.columns))])
    more = [StructField("ids", ArrayType(IntegerType(), False)), *([StructField("decoded", StringType())] if decoded else [])]
    return plain.mapInArrow(trimming(run), StructType([*plain.schema.fields, *more])).toDF(*names)


def decode(tokens: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """`tokens` with the text of each list of ids; a null list counts as empty."""
    tokens = tokens.drop(text)
    at = tokens.columns.index(ids)

    def run(batches):
        from driftlake.llm import bpe

        decoder = bpe.coder(path)[1]
        for b in batches:
            col = b.column(at)
            out = [decoder.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else "" for x in col]
            yield pa.record_batch([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, text])

    from pyspark.sql.types import StringType, StructField, StructType

    return tokens.mapInArrow(trimming(run), StructType([*tokens.schema.fields, StructField(text, StringType())]))


def digests(both: DataFrame, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 from what encode() and decode() gave."""
    return both.select(
        "doc_id",
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col(ids).cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col(text).cast("binary"), 256).alias("decoded_sha256"),
    )


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = default_vocabulary()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(encode(docs, path, decoded="decoded").drop("text"))
