"""Benchmark leaks: a BM25 index of test items, searched by training passages.

Every passage of a training text (overlapping windows of words) is a query;
an item matches if its BM25 score reaches a share of the score that the
item's own text would get. Items are laid out in blocks, and each term holds
its largest impact per block: the sum of these over a passage bounds every
item of a block, so whole blocks whose bound stays under the threshold are
passed over (block-max pruning), and so are passages without a block. What
is left is scored exactly; matches are verified on the question and the
answer part of the item.

Cases: null texts and texts or items without words have no matches; words
are compared in lower case (A-Z) without ASCII signs; repeated items are
items of their own; rows repeated with one id are one document; an empty
table on either side gives an empty result.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemark.llm.common import kept_by_worker, small_side
from ripplemark.session import stage

K1, B = 1.2, 0.75
#: Share of an item's own score that a passage must reach.
SCORE = 0.6
#: Shares of the question's word 5-grams and of the answer's words found in the document's passage.
QUESTION, ANSWER, GRAM = 0.5, 0.5, 5
#: Items of one block, and of one shard of the index; more items mean more shards, each searched by all passages.
BLOCK, SHARD = 8, 2048
CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
SENTENCE_ENDS = b".?!\n"


def words_of(data: bytes) -> list[bytes]:
    return data.translate(CLEAN).split()


def question_and_answer(data: bytes) -> tuple[list[bytes], list[bytes]]:
    """The last sentence is the answer, what stands before it the question; one sentence alone is a question."""
    body = data.rstrip(SENTENCE_ENDS + b" \t\r")
    cut = max(body.rfind(bytes((c,))) for c in SENTENCE_ENDS)
    head, tail = (body[: cut + 1], body[cut + 1 :]) if cut >= 0 else (body, b"")
    question, answer = words_of(head), words_of(tail)
    return (question, answer) if question else (answer, question)


def grams(words: list[bytes]) -> set[bytes]:
    n = min(GRAM, len(words))
    return {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


class Index:
    """One shard: impacts scaled so that an item's own text scores 1, and their largest per block.

    ``longest``: words of the longest item of all shards, so that a text has the same passages in each.
    """

    def __init__(self, items: list[tuple[int, bytes]], frequency: dict[bytes, int], n_items: int, mean_length: float, longest: int):
        items = [(i, t, w) for i, t in items if (w := words_of(t))]
        self.ids = [i for i, _, _ in items]
        self.parts = [question_and_answer(t) for _, t, _ in items]
        self.grams = [grams(q) for q, _ in self.parts]
        self.terms: dict[bytes, int] = {}
        entries = []
        for at, (_, _, words) in enumerate(items):
            counts: dict[bytes, int] = {}
            for w in words:
                counts[w] = counts.get(w, 0) + 1
            norm = K1 * (1 - B + B * len(words) / mean_length)
            impacts = {w: np.log1p((n_items - frequency[w] + 0.5) / (frequency[w] + 0.5)) * n * (K1 + 1) / (n + norm) for w, n in counts.items()}
            own = sum(impacts.values())
            entries += [(self.terms.setdefault(w, len(self.terms) + 1), at, v / own) for w, v in impacts.items()]
        blocks = -(-len(items) // BLOCK)
        self.impact = np.zeros((len(self.terms) + 1, max(blocks, 1) * BLOCK), dtype=np.float32)
        for term, at, v in entries:
            self.impact[term, at] = v
        self.most = self.impact.reshape(len(self.terms) + 1, max(blocks, 1), BLOCK).max(axis=2)
        self.longest = longest

    def search(self, data: bytes, score: float = SCORE) -> list[tuple[int, float, float, float]]:
        """(item, score, question share, answer share) of the items that leaked into a text."""
        words = words_of(data)
        if not words or not self.ids:
            return []
        get = self.terms.get
        codes = np.array([get(w, 0) for w in words], dtype=np.int32)
        # Passages are two strides long and start every stride: any run of `stride` words lies in one.
        stride = max(2 * self.longest, 64)
        places = np.nonzero(codes)[0]
        if not len(places):
            return []
        strides = places // stride
        # A term counts once per stride.
        keys = np.unique(strides * len(self.impact) + codes[places])
        cells, terms = keys // len(self.impact), keys % len(self.impact)
        starts = np.concatenate(([0], np.nonzero(np.diff(cells))[0] + 1))
        bound = np.zeros((int(cells[-1]) + 2, self.most.shape[1]), dtype=np.float32)
        for at in range(0, len(starts), 4096):
            some = starts[at : at + 4096]
            end = starts[at + 4096] if at + 4096 < len(starts) else len(terms)
            bound[cells[some]] = np.add.reduceat(self.most[terms[some[0] : end]], some - some[0], axis=0)
        found: dict[int, tuple[float, float, float]] = {}
        passages, blocks = np.nonzero(bound[:-1] + bound[1:] >= score - 1e-4)
        for n in np.unique(passages).tolist():
            lo, hi = np.searchsorted(cells, [n, n + 2])
            mine = np.unique(terms[lo:hi])
            near = blocks[passages == n] if len(passages) < 64 else blocks[slice(*np.searchsorted(passages, [n, n + 1]))]
            columns = (near[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            scores = self.impact[np.ix_(mine, columns)].sum(axis=0)
            hits = np.nonzero(scores >= score - 1e-4)[0]
            if not len(hits):
                continue
            passage = words[n * stride : (n + 2) * stride]
            inside, held = grams_in(passage), set(passage)
            for h in hits.tolist():
                at = int(columns[h])
                if at >= len(self.ids):
                    continue
                question, answer = self.parts[at]
                width = min(GRAM, len(question))
                have = inside if width == GRAM else grams_of(passage, width)
                q = len(self.grams[at] & have) / len(self.grams[at])
                a = sum(w in held for w in answer) / len(answer) if answer else 1.0
                # Each passage is judged by itself: one that holds more of the question must not hide one that holds both.
                if q >= QUESTION and a >= ANSWER:
                    found[at] = max(found.get(at, (0.0, 0.0, 0.0)), (q, a, round(float(scores[h]), 4)))
        return [(self.ids[at], s, q, a) for at, (q, a, s) in sorted(found.items())]


def grams_of(words: list[bytes], n: int) -> set[bytes]:
    return {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}


def grams_in(words: list[bytes]) -> set[bytes]:
    return grams_of(words, GRAM)


def index_shards(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", shard: int = SHARD):
    """The index's contents, one shard of about ``shard`` items at most after the other.

    Frequencies, the mean and the longest length are taken over all items, on
    the cluster. Repeated items are counted there, and searched for once. A
    shard's items and their terms are bounded by ``shard`` times the length
    of an item; it is the query set that is cut, never the passages.
    """
    clean = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123))))
    bare = F.split(F.trim(F.regexp_replace(clean, r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", " ")), " ")
    numbered = benchmark.select(F.col(id_col).cast("bigint").alias("item_id"), F.col(text_col).cast("string").alias("body"), F.filter(bare, lambda w: w != "").alias("words"))
    items = stage(numbered, "items")
    n, mean, longest = items.where(F.size("words") > 0).agg(F.count(F.lit(1)), F.avg(F.size("words")), F.max(F.size("words"))).first()
    if not n:
        return
    frequency = stage(items.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").count(), "frequency")
    items = stage(items.groupBy("item_id", "body").agg(F.first("words").alias("words")), "distinct_items")
    several = items.where(F.size("words") > 0).count()
    shards = -(-several // max(shard // 2, 1)) if several > shard else 1
    mine = F.pmod(F.xxhash64("item_id", "body"), F.lit(shards))
    for k in range(shards):
        part = items.where(mine == k)
        used = part.select(F.explode(F.array_distinct("words")).alias("word")).distinct().join(frequency, "word")
        counts = {r["word"].encode(): r["count"] for r in used.toLocalIterator()}
        texts = [(r["item_id"], (r["body"] or "").encode()) for r in part.orderBy("item_id", "body").toLocalIterator()]
        yield texts, counts, n, mean, longest


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", score: float = SCORE, shard: int = SHARD) -> DataFrame:
    """Verified leaks: ``doc_id, item_id, score, question_overlap, answer_overlap``, best passage of each pair."""
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("body"))
    schema = "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double"
    found = None
    for number, contents in enumerate(index_shards(benchmark, shard=shard)):
        shared, mark = sc.broadcast(contents), f"{uuid.uuid4().hex}-{number}"

        def read(batches, shared=shared, mark=mark):
            index = kept_by_worker("index", mark, lambda: Index(*shared.value))
            for batch in batches:
                out = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
                    out += [(doc, *hit) for hit in index.search(text.as_py() or b"", score)]
                columns = list(zip(*out)) if out else [[]] * 5
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        # Written shard by shard, so that one shard at a time is held by the driver and the workers.
        part = stage(rows.mapInArrow(read, schema), "hits")
        shared.destroy()
        found = part if found is None else found.union(part)
    if found is None:
        return rows.limit(0).select("doc_id", *[F.lit(None).cast(t).alias(c) for c, t in [("item_id", "bigint"), ("score", "double"), ("question_overlap", "double"), ("answer_overlap", "double")]])
    best = F.max(F.struct("question_overlap", "answer_overlap", "score")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.score", "best.question_overlap", "best.answer_overlap")


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All columns of the documents without a verified leak.

    Documents are named by a hash of the whole text, so rows without or with
    repeated ids are told apart; only the names of leaking texts are joined.
    """
    mark = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    hit = leaks(docs.select(mark.alias("doc_id"), "text"), benchmark)
    gone = stage(hit.select(F.col("doc_id").alias("h")).distinct(), "leaking")
    return docs.select(F.struct("*").alias("row"), mark.alias("h")).join(small_side(gone), "h", "left_anti").select("row.*")
