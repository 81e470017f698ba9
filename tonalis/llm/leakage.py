"""Passages of held-out items inside a corpus: a BM25 index of the items, asked with every passage of every document."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
import unicodedata
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonalis.materialise import spread

#: Consecutive words that make a leak; words of a passage; items whose postings share one upper bound.
RUN, PASSAGE, BLOCK = 8, 16, 16
#: Items of one index, and characters of item text sent to the executors at a time; more items take further passes.
SHARD_ITEMS, PASS_CHARS = 1000, 16_000_000
K1, B = 1.2, 0.75

_MARKS, _WORD = regex.compile(r"\p{M}+"), regex.compile(r"[\p{L}\p{N}]+")


def words(text: str | None) -> list[str]:
    """Runs of letters and digits in lower case, without combining marks after compatibility decomposition."""
    if not text:
        return []
    text = text.lower()
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text)).lower()
    return _WORD.findall(text)


def _marks_of(terms: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the run of RUN terms that begins at each place."""
    runs = max(0, len(terms) - RUN + 1)
    out = np.zeros(runs, dtype=np.uint64)
    for k in range(RUN):
        out = out * np.uint64(0x9E3779B97F4A7C15) + terms[k : k + runs].astype(np.uint64) + np.uint64(1)
    return out


class ItemIndex:
    """BM25 postings of a shard of items with block maxima.

    Weights are divided by the item's own threshold: the least score that any run of RUN words of the item reaches. A passage
    that holds such a run therefore scores 1 or more, so retrieving all above 1 loses no leak.
    """

    def __init__(self, items: list[tuple[int, list[str]]]) -> None:
        items = [(i, w) for i, w in items if len(w) >= RUN]
        self.ids = [i for i, _ in items]
        self.terms: dict[str, int] = {}
        coded = [np.array([self.terms.setdefault(x, len(self.terms)) for x in w], dtype=np.int32) for _, w in items]
        n, size = len(items), len(self.terms)
        mean = sum(len(w) for w in coded) / max(n, 1)
        df = np.zeros(size)
        for w in coded:
            df[np.unique(w)] += 1
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        self.grams: list[set[bytes]] = []
        self.marks: list[np.ndarray] = []
        blocks = -(-n // BLOCK)
        self.bound = np.zeros((size + 1, blocks), dtype=np.float32)  # the last row is for words that no item has
        self.local: list[np.ndarray] = []
        self.weight: list[np.ndarray] = []
        for b in range(blocks):
            part = range(b * BLOCK, min(n, (b + 1) * BLOCK))
            own = np.unique(np.concatenate([coded[k] for k in part]))
            w = np.zeros((len(own) + 1, len(part)), dtype=np.float64)
            for j, k in enumerate(part):
                t, tf = np.unique(coded[k], return_counts=True)
                score = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(coded[k]) / mean))
                full = np.zeros(size + 1)
                full[t] = score
                runs = np.lib.stride_tricks.sliding_window_view(coded[k], RUN)
                least = min(full[np.unique(r)].sum() for r in runs)
                w[np.searchsorted(own, t), j] = score / least
                self.grams.append({r.tobytes() for r in runs})
                self.marks.append(np.unique(_marks_of(coded[k])))
            self.local.append(own)
            self.weight.append(w)
            self.bound[own, b] = w[:-1].max(axis=1)

    def rows(self, block: int, terms: np.ndarray) -> np.ndarray:
        """The rows of a block's weights for terms; a term that none of its items has points at the last row, all zeros."""
        own = self.local[block]
        at = np.full(len(self.terms) + 1, len(own), dtype=np.int32)
        at[own] = np.arange(len(own))
        return at[terms]

    def search(self, docs: list[np.ndarray]) -> dict[tuple[int, int], set[int]]:
        """(position in docs, position in ids) -> positions of the document's words inside shared runs.

        ``docs`` holds the term of each word, or the number of terms for a word that no item has.
        """
        found: dict[tuple[int, int], set[int]] = {}
        if not self.ids or not docs:
            return found
        none = len(self.terms)
        gap = np.full(PASSAGE, none, dtype=np.int32)
        flat = np.concatenate([x for w in docs for x in (w, gap)])
        size = np.array([len(w) for w in docs])
        begin = np.concatenate([[0], np.cumsum(size + PASSAGE)[:-1]])
        step = PASSAGE - RUN + 1  # neighbours share RUN - 1 words: every run lies whole in one passage
        many = np.maximum(0, -(-(size - RUN + 1) // step))
        owner = np.repeat(np.arange(len(docs)), many)
        at = begin[owner] + step * (np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many))
        marks = _marks_of(flat)
        for lo in range(0, len(owner), 8192):
            first = at[lo : lo + 8192]
            terms = np.sort(flat[first[:, None] + np.arange(PASSAGE)], axis=1)
            terms[:, 1:][terms[:, 1:] == terms[:, :-1]] = none  # a repeated word counts once
            # block-max: the sum of a block's maxima bounds every score in it; blocks below 1 are skipped whole
            bound = np.zeros((len(first), self.bound.shape[1]), dtype=np.float32)
            for k in range(PASSAGE):
                bound += self.bound[terms[:, k]]
            p, b = np.nonzero(bound >= 0.999)
            for block in np.unique(b):
                mine = p[b == block]
                score = self.weight[block][self.rows(block, terms[mine])].sum(axis=1)
                for j in range(score.shape[1]):
                    k, asked = int(block) * BLOCK + j, mine[score[:, j] >= 0.999]
                    runs = first[asked][:, None] + np.arange(step)
                    for m, o in zip(*np.nonzero(np.isin(marks[runs], self.marks[k]))):
                        r = int(runs[m, o])
                        if flat[r : r + RUN].tobytes() in self.grams[k]:  # word by word
                            found.setdefault((int(owner[lo + asked[m]]), k), set()).update(range(r, r + RUN))
        return found


def _scan(batches: Iterable[pd.DataFrame], shards: list[ItemIndex]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        ids, out = batch["doc"].tolist(), []
        split = [words(t) for t in batch["text"]]
        for index in shards:
            get = index.terms.get
            none = len(index.terms)
            coded = [np.fromiter((get(x, none) for x in w), dtype=np.int32, count=len(w)) for w in split]
            out += [(ids[d], index.ids[k], len(at)) for (d, k), at in index.search(coded).items()]
        yield pd.DataFrame(out, columns=["doc", "item", "palabras"]).astype({"palabras": "int32"})


def find_leaks(documents: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, palabras): documents that hold RUN or more consecutive words of an item, and how many of their words
    lie in such runs.

    Every document is cut into passages of PASSAGE words that overlap by RUN - 1; every passage queries the index; what
    scores at or above the item's threshold is verified word by word.

    Defined cases: null or empty texts and items of fewer than RUN words give nothing; an item without its id and a document
    without its id are left out; a document id on several rows counts once, with its largest overlap; repeated items with
    other ids are each reported; an empty table gives an empty result; further columns are ignored.

    Plan: one pass over the documents without any shuffle of text; the items travel to the executors in indexes of at
    most SHARD_ITEMS items and PASS_CHARS characters at a time, whatever their number; the result is aggregated by key.
    """
    spark = documents.sparkSession
    docs = spread(documents.filter(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc"), F.col(text).alias("text")), "doc")
    some = items.filter(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(F.col(item_id).alias("item"), F.col(text).alias("text"))
    n, chars = some.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    passes = max(1, -(-chars // PASS_CHARS), -(-n // (20 * SHARD_ITEMS)))
    out = None
    kind = {f.name: f.dataType.simpleString() for f in documents.schema}[doc_id], {f.name: f.dataType.simpleString() for f in items.schema}[item_id]
    for k in range(passes):
        part = sorted((r.item, words(r.text)) for r in some.filter(F.pmod(F.xxhash64("item"), F.lit(passes)) == k).collect())
        shards = [ItemIndex(part[s : s + SHARD_ITEMS]) for s in range(0, len(part), SHARD_ITEMS)]
        sent = spark.sparkContext.broadcast(shards)
        hits = docs.mapInPandas(lambda it, sent=sent: _scan(it, sent.value), f"doc {kind[0]}, item {kind[1]}, palabras int")
        out = hits if out is None else out.unionByName(hits)
    return out.groupBy("doc", "item").agg(F.max("palabras").alias("palabras")).select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), "palabras")
