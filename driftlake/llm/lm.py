"""Language-model scores from a lattice of subwords.

The vocabulary and its scores are those of an existing sentencepiece model; they weight every segmentation of a word,
and the forward recursion in log space sums over all of them. `ROUNDS` rounds of expectation-maximisation over all
distinct training words, weighted by their counts, bring the existing scores to the corpus. A text is its words and an
end; its score is the marginal probability over all segmentations of all its words, known or not.

The base score gives every unseen word one slot and does not spell it, and every known word its own count; the lattice
spells all words by pieces, so its score is a probability of the text itself, on another scale.

Counts grow with the corpus, so nothing but the pieces' weights (the vocabulary's size) is sent to all tasks. Rows
are dealt to chunks of bounded text; a chunk asks for its distinct words once, word counts are summed by word, and the
answers go back to the chunk, which sums over its texts. A word that is in all texts is one row for each chunk.

Defined results: a null text is empty, and its only token is the end; a null id is never held out; repeated rows get
a row each and count as often; an empty table gives an empty result; without training rows base scores are 0 by the
formula, and the model's rest on the existing scores; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlake.llm.common import materialise, shuffle_partitions, table, trimming
from driftlake.llm.langid import fold

#: Bytes of text in a chunk, about.
CHUNK = 1 << 24
#: The end token; no word holds white space.
END = "\n"
#: Weight of the existing scores, in pieces, beside what the corpus says; mass of all 256 fallback bytes.
PRIOR, BYTES = 1_000.0, 1e-3
#: Rounds of expectation-maximisation.
ROUNDS = 2
#: Words longer than this are walked one by one.
LONG = 48
_SPACE = "▁"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_pieces(path: str) -> tuple[list[str], np.ndarray]:
    """Ordinary pieces and their log weights, which sum to one; scores that are ranks are read as Zipf weights."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
    scores = np.array([sp.get_score(i) for i in ids])
    w = 1 / (10 - scores) if scores.min() < -1000 else np.exp(scores)
    return [sp.id_to_piece(i) for i in ids], np.log(w / w.sum())


class Lattice:
    """Log weights of pieces, found by a hash of their code points, many words at a time."""

    def __init__(self, pieces: list[str], log_weight: np.ndarray, stop: float):
        self.pieces, self.w = pieces, np.append(log_weight, -np.inf)
        self.ids = {p: i for i, p in enumerate(pieces)}
        self.longest = max(map(len, pieces), default=1)
        self.log_stop = math.log(stop)
        self.byte = math.log(BYTES / 256)
        h = np.array([self._hash_of(p) for p in pieces], np.uint64)
        if len(set(h.tolist())) != len(pieces):
            raise ValueError("two pieces have one hash")
        self.slots = []
        left, bits = np.arange(len(pieces)), 18
        while len(left):
            keys, vals = np.zeros(1 << bits, np.uint64), np.full(1 << bits, len(pieces), np.int32)
            odd, shift = np.uint64(0xD6E8FEB86659FD93 + 2 * len(self.slots)), np.uint64(64 - bits)
            at = ((h[left] * odd) >> shift).astype(np.int64)
            _, one = np.unique(at, return_index=True)
            keys[at[one]], vals[at[one]] = h[left[one]], left[one]
            self.slots.append((odd, shift, keys, vals))
            left, bits = np.delete(left, one), max(10, bits - 4)

    @staticmethod
    def _hash_of(p: str) -> int:
        x = 0
        for c in p:
            x = ((x ^ ord(c)) * int(_MIX) + 1) & (1 << 64) - 1
        return x

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece of each hash; the number of pieces where there is none."""
        out = np.full(len(h), len(self.pieces), np.int32)
        for odd, shift, keys, vals in self.slots:
            at = ((h * odd) >> shift).astype(np.int64)
            np.copyto(out, vals[at], where=keys[at] == h)
        return out

    def _fallback(self, u: np.ndarray) -> np.ndarray:
        """Log weight of each code point as bytes."""
        return ((u >= 0).astype(np.int8) + (u > 0x7F) + (u > 0x7FF) + (u > 0xFFFF)) * self.byte

    def arcs(self, u: np.ndarray):
        """(start, end, piece or none, log weight) of all spans of words of one length (rows of code points)."""
        n, length = u.shape
        for i in range(length):
            h = np.zeros(n, np.uint64)
            for j in range(i, min(length, i + self.longest)):
                h = (h ^ u[:, j]) * _MIX + np.uint64(1)
                piece = self.find(h)
                w = self.w[piece]
                if j == i:
                    w = np.where(piece == len(self.pieces), self._fallback(u[:, j]), w)
                elif np.isneginf(w).all():
                    continue
                yield i, j + 1, piece, w

    def log_marginals(self, words: list[str]) -> np.ndarray:
        """Natural log of the lattice's probability of each word."""
        out = np.empty(len(words))
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            if len(w) >= LONG:
                out[k] = self._long(_SPACE + w)
            else:
                by_length.setdefault(len(w), []).append(k)
        for length, ks in by_length.items():
            for at in range(0, len(ks), 8192):
                some = ks[at : at + 8192]
                u = self._points([words[k] for k in some], length)
                a = np.full((length + 2, len(some)), -np.inf)
                a[0] = 0
                for i, j, _, w in self.arcs(u):
                    a[j] = np.logaddexp(a[j], a[i] + w)
                out[some] = a[-1] + self.log_stop
        return out

    @staticmethod
    def _points(words: list[str], length: int) -> np.ndarray:
        text = _SPACE + _SPACE.join(words) if length else _SPACE * len(words)
        return np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(len(words), length + 1).astype(np.uint64)

    def _long(self, s: str) -> float:
        """The same recursion for one word; it holds as many values as the longest piece has characters."""
        ids, w, longest = self.ids, self.w, self.longest
        last = [0.0]  # of the positions before j, the nearest last
        for j in range(1, len(s) + 1):
            terms = []
            for d in range(1, min(longest, j) + 1):
                if (p := ids.get(s[j - d : j])) is not None:
                    terms.append(last[-d] + w[p])
                elif d == 1:
                    terms.append(last[-1] + len(s[j - 1].encode()) * self.byte)
            top = max(terms)
            last.append(top + math.log(sum(math.exp(t - top) for t in terms)))
            if len(last) > longest:
                del last[0]
        return last[-1] + self.log_stop

    def _spans(self, s: str, j: int):
        """(start, piece or none, log weight) of the spans of a word that end at j."""
        for i in range(max(0, j - self.longest), j):
            if (p := self.ids.get(s[i:j])) is not None:
                yield i, p, self.w[p]
            elif i == j - 1:
                yield i, len(self.pieces), len(s[i].encode()) * self.byte

    def _long_expected(self, s: str, n: float, out: np.ndarray) -> None:
        """Adds the expected uses of each piece in one word that occurs n times."""
        a, b = np.full(len(s) + 1, -np.inf), np.full(len(s) + 1, -np.inf)
        a[0] = b[-1] = 0
        for j in range(1, len(s) + 1):
            a[j] = np.logaddexp.reduce([a[i] + w for i, _, w in self._spans(s, j)])
        for j in range(len(s), 0, -1):
            for i, p, w in self._spans(s, j):
                out[p] += n * math.exp(a[i] + w + b[j] - a[-1])
                b[i] = np.logaddexp(b[i], b[j] + w)

    def expected(self, words: list[str], n: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in words that occur n times."""
        out = np.zeros(len(self.pieces) + 1)
        cut: Counter = Counter()
        for w, c in zip(words, n.tolist(), strict=True):
            cut[w] += c
        by_length: dict[int, list[str]] = {}
        for w, c in cut.items():
            if len(w) >= LONG:
                self._long_expected(_SPACE + w, c, out)
            else:
                by_length.setdefault(len(w), []).append(w)
        for length, ws in by_length.items():
            for at in range(0, len(ws), 4096):
                some = ws[at : at + 4096]
                count = np.array([cut[w] for w in some], float)
                arcs = [x for x in self.arcs(self._points(some, length))]
                a = np.full((length + 2, len(some)), -np.inf)
                b = a.copy()
                a[0], b[-1] = 0, 0
                for i, j, _, w in arcs:
                    a[j] = np.logaddexp(a[j], a[i] + w)
                for i, j, _, w in reversed(arcs):
                    b[i] = np.logaddexp(b[i], b[j] + w)
                total = a[-1]
                for i, j, piece, w in arcs:
                    out += np.bincount(piece, np.exp(a[i] + w + b[j] - total) * count, len(out))
        return out[:-1]


def _words(text: bytes) -> list[bytes]:
    return text.lower().split()


def _chunked(docs: DataFrame, id_col: str, text: str, held: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.col(held).alias("held"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(shuffle_partitions(docs.sparkSession), -(-size // CHUNK))
    return rows.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("int"))


def word_table(chunked: DataFrame) -> DataFrame:
    """(word, chunk, c): distinct words of each chunk, END included, with their count in its training rows."""

    def run(batches):
        now, seen = None, Counter()

        def flush():
            words = list(seen)
            for at in range(0, len(words), 50_000):
                part = words[at : at + 50_000]
                yield pa.record_batch([pa.array(part, pa.binary()).cast(pa.string()), pa.array(np.full(len(part), now, np.int32)), pa.array([seen[w] for w in part], pa.int64())], names=["word", "chunk", "c"])

        for b in batches:
            texts = b.column(1).cast(pa.binary())
            for chunk, t, held in zip(b.column(0).to_pylist(), texts, b.column(2).to_pylist(), strict=True):
                if chunk != now:
                    if seen:
                        yield from flush()
                    now, seen = chunk, Counter()
                words = _words(t.as_py())
                if held:
                    for w in (*words, b"\n"):
                        if w not in seen:
                            seen[w] = 0
                else:
                    seen.update(words)
                    seen[b"\n"] += 1
        if seen:
            yield from flush()

    rows = chunked.select("chunk", "text", "held").repartition("chunk").sortWithinPartitions("chunk")
    return rows.mapInArrow(trimming(run), "word string, chunk int, c long")


def score(docs: DataFrame, held: str, id_col: str = "doc_id", text: str = "text", pieces: str | None = None) -> DataFrame:
    """(id, held, n_tokens, n_known, train_tokens, base_score, score) of each row; rows with `held` are not learned from."""
    chunked = _chunked(docs, id_col, text, held)
    asked = materialise(word_table(chunked), "lm-asked")
    counts = materialise(asked.groupBy("word").agg(F.sum("c").alias("c")), "lm-counts")
    is_word = F.col("word") != END
    got = counts.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n"),
        F.count_if(F.col("c") > 0).alias("v"),
        F.coalesce(F.sum(F.when(~is_word, F.col("c"))), F.lit(0)).alias("ends"),
    ).first()
    n, v, ends = (int(x) for x in got)
    n_words = n - ends
    names, prior = load_pieces(pieces or default_pieces())
    weights, stop = prior, 0.3
    for _ in range(ROUNDS):
        start = Lattice(names, weights + math.log(1 - BYTES) + math.log(1 - stop), stop)

        def expect(batches, start=start):
            total = np.zeros(len(names))
            for b in batches:
                total += start.expected(b.column(0).to_pylist(), b.column(1).to_numpy())
            used = np.flatnonzero(total)
            yield pa.record_batch([pa.array(used), pa.array(total[used])], names=["piece", "n"])

        seen = counts.where(is_word & (F.col("c") > 0)).mapInArrow(trimming(expect), "piece long, n double")
        uses = np.exp(prior) * PRIOR
        for r in seen.groupBy("piece").agg(F.sum("n").alias("n")).collect():  # a row for each piece of the vocabulary at most
            uses[r.piece] += r.n
        weights = np.log(uses / uses.sum())
        stop = (n_words + 0.3 * PRIOR) / (n_words + 0.3 * PRIOR + uses.sum())
    model = Lattice(names, weights + math.log(1 - BYTES) + math.log(1 - stop), stop)
    word_share, end_share = math.log((n_words + 1) / (n + 2)), math.log((ends + 1) / (n + 2))

    def weigh(batches):
        for b in batches:
            words = b.column(0).to_pylist()
            lp = model.log_marginals(words) + word_share
            lp[[i for i, w in enumerate(words) if w == END]] = end_share
            yield pa.record_batch([b.column(0), b.column(1), pa.array(lp / math.log(10))], names=["word", "c", "lp"])

    weighed = counts.mapInArrow(trimming(weigh), "word string, c long, lp double")
    answers = asked.select("word", "chunk").join(weighed, "word").select("chunk", "word", "c", "lp")

    kind = chunked.schema["id"].dataType.simpleString()
    bottom = n + (v + 1)

    def total(texts: pa.Table, words: pa.Table) -> pa.Table:
        c = words.column("c").to_numpy()
        lp, known = words.column("lp").to_numpy(), c > 0
        base = np.log10((c + 1) / bottom)
        at = {w: i for i, w in enumerate(words.column("word").cast(pa.binary()).to_pylist())}
        out = []
        for t in texts.column("text").cast(pa.binary()).to_pylist():
            ws = [*_words(t), b"\n"]
            i = np.fromiter(map(at.__getitem__, ws), np.intp, len(ws))
            out.append((len(i), int(known[i].sum()), float(base[i].sum()), float(lp[i].sum())))
        tokens, known_, base_, score_ = zip(*out, strict=True) if out else ((), (), (), ())
        return pa.table(
            {
                "id": texts.column("id"),
                "held": texts.column("held"),
                "n_tokens": pa.array(tokens, pa.int64()),
                "n_known": pa.array(known_, pa.int64()),
                "train_tokens": pa.array([n] * len(out), pa.int64()),
                "base_score": pa.array(base_, pa.float64()),
                "score": pa.array(score_, pa.float64()),
            }
        )

    schema = f"id {kind}, held boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return chunked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(total, schema)


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", fold("doc_id", 7, 2))
    out = score(docs, "held_out")
    return out.withColumnRenamed("id", "doc_id").withColumnRenamed("held", "held_out")
