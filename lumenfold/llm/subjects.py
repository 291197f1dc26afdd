"""Subject areas of documents, by bisecting k-means over their passages.

Documents mix subjects, so what is clustered are the normalised vectors of their
clauses (hashed terms weighted by inverse frequency, projected to a few
dimensions). The leaves of the bisecting tree are labelled from a hand-labelled
sample: a leaf's share of each subject, spread over leaves that occur in the
same documents, and the terms that set each subject apart. A sentence belongs
to the subject its clauses' leaves favour; a document to the subjects that take
up a given share of its sentences.

Texts are read once: each document becomes arrays of numbers (the buckets of its
terms by clause and sentence), written to the shared folder, and every later
pass is array arithmetic on whole batches of these.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm import leaks
from lumenfold.plans import lineage

BUCKETS, DIM = 1 << 15, 64
LEAVES = 512
SHARE = 0.25
#: A sentence that favours no subject by at least this is a general remark.
LEAST_LEAF, LEAST = 0.08, 0.13
#: How much more the documents of the labelled sample count when terms are judged, round by round.
LABELLED = (25.0, 5.0, 5.0)
#: Leaves seen less often in labelled documents than this lean on their neighbours alone.
SMOOTH = 4.0
_SENT = re.compile(r"(?<=[。！？!?])\s*|(?<=[.!?][\"”’)])\s+|(?<=\.)\s+")
_ABBREVIATED = re.compile(r"(?:\b(?:al|No|Nr|Vol|Fig|Tab|ca|cf|vs|sp|spp|var|resp|Dr|Prof|St|e\.g|i\.e|z\.B|d\.h|bzw|usw))\.\Z")
_CLAUSE = re.compile(r"[,，;；:：—–]\s*(?=\D)")
_TERM = re.compile(r"[㐀-䶿一-鿿]+|[^\W\d_㐀-䶿一-鿿]{2,}")


def sentences(text: str) -> list[str]:
    """Sentences of text; line breaks within a sentence are blanks, a point of an abbreviation ends none."""
    flat = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text.replace("﻿", "").replace("。", "。 ")).replace(" ", ""))
    out: list[str] = []
    for s in _SENT.split(flat):
        if not s or not s.strip():
            continue
        if out and (_ABBREVIATED.search(out[-1]) or s.startswith("(")) and out[-1].endswith("."):
            out[-1] += " " + s
        else:
            out.append(s.strip())
    return [s for s in out if any(c.isalnum() for c in s)]


def terms(clause: str) -> list[str]:
    out = []
    for run in _TERM.findall(clause.lower()):
        if "㐀" <= run[0] <= "鿿":
            out += [run[i:i + 2] for i in range(len(run) - 1)] or [run]
        else:
            out.append(run)
    return out


def _bucket(term: str) -> int:
    return xxhash.xxh32_intdigest(term) % BUCKETS


def clauses(sentence: str) -> list[str]:
    return [c for c in _CLAUSE.split(sentence) if c and c.strip()]


def _list(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType = pa.int32()) -> pa.Array:
    """values cut into lists of the given sizes."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, kind))


def _flat(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """(values of all lists of a column, size of each)."""
    lists = batch.column(column)
    return lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of the rows of values by runs of the given sizes; an empty run is 0."""
    out = np.zeros((len(sizes), *values.shape[1:]), values.dtype)
    full = np.flatnonzero(sizes)
    if len(full):
        out[full] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[full], axis=0)
    return out


class Passages:
    """Whether a sentence shares a run of tokens with an evaluation item."""

    def __init__(self, items: list[tuple[str, str, str]]) -> None:
        self.short, self.long = ({tuple(toks[i:i + n]) for toks in (leaks.tokens(t) for *_, t in items) for i in range(len(toks) - n + 1)} for n in (4, leaks.MIN_TILE))

    def kind(self, sentence: str) -> int:
        """2 for a run of MIN_TILE tokens, 1 for one of 4, 0 for none."""
        toks, n = leaks.tokens(sentence), leaks.MIN_TILE
        if not any(tuple(toks[i:i + 4]) in self.short for i in range(len(toks) - 3)):
            return 0
        return 2 if any(tuple(toks[i:i + n]) in self.long for i in range(len(toks) - n + 1)) else 1


def parsed(docs: DataFrame, items: list[tuple[str, str, str]]) -> DataFrame:
    """(doc_id, keys, clauses, sentences, aside): each text as numbers.

    keys are the buckets of the terms, distinct within each clause; clauses the
    number of keys of each clause, sentences the number of clauses of each
    sentence, aside what Passages tells of each sentence.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages, memo, buckets, judged = Passages(items), {}, {}, {}

        def keys_of(clause: str) -> list[int]:
            k = memo.get(clause)
            if k is None:
                if len(memo) > 100_000:
                    memo.clear()
                if len(buckets) > 500_000:
                    buckets.clear()
                got = set()
                for t in terms(clause):
                    b = buckets.get(t)
                    if b is None:
                        b = buckets[t] = _bucket(t)
                    got.add(b)
                k = memo[clause] = sorted(got)
            return k

        for batch in batches:
            keys, n_keys, n_clauses, aside, per_doc = [], [], [], [], []
            for t in batch.column("text").to_pylist():
                before = len(n_keys), len(keys), len(n_clauses)
                for s in sentences(t):
                    cs = clauses(s)
                    for c in cs:
                        k = keys_of(c)
                        keys += k
                        n_keys.append(len(k))
                    n_clauses.append(len(cs))
                    a = judged.get(s)
                    if a is None:
                        if len(judged) > 100_000:
                            judged.clear()
                        a = judged[s] = passages.kind(s)
                    aside.append(a)
                per_doc.append((len(keys) - before[1], len(n_keys) - before[0], len(n_clauses) - before[2]))
            n = np.array(per_doc, np.int32).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _list(keys, n[:, 0]), _list(n_keys, n[:, 1]), _list(n_clauses, n[:, 2]), _list(aside, n[:, 2])], ["doc_id", "keys", "clauses", "sentences", "aside"])

    return lineage.written(docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, keys array<int>, clauses array<int>, sentences array<int>, aside array<int>"), "parsed")


def term_weights(texts: DataFrame, rare: float = 3e-4) -> np.ndarray:
    """Inverse frequency of each bucket of terms over all clauses; 0 for buckets too rare to tell anything.

    The counts are arrays of BUCKETS numbers, one per task, summed by bucket.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            n += np.bincount(_flat(batch, "keys")[0], minlength=BUCKETS)
            total += int(_flat(batch, "clauses")[1].sum())
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1], pa.int32()), pa.array([*n[at].tolist(), total], pa.int64())], ["bucket", "n"])

    got = dict(texts.select("keys", "clauses").mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect())  # at most BUCKETS + 1 rows
    total = got.pop(-1, 0)
    w = np.zeros(BUCKETS, np.float32)
    least = max(3.0, rare * total)
    for b, n in got.items():
        if n >= least:
            w[b] = np.log(1 + total / n)
    return w


class Vectors:
    """Vectors of clauses from the weights of their terms."""

    def __init__(self, weight: np.ndarray) -> None:
        self.weight = weight
        self.basis = np.random.default_rng(11).normal(size=(BUCKETS, DIM)).astype(np.float32)

    def of(self, keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Unit vectors of clauses that have the given numbers of keys."""
        v = _sums(self.weight[keys, None] * self.basis[keys], sizes)
        return v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-9)


def _known(keys: np.ndarray, sizes: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys with a weight, and how many of them each clause has."""
    keep = weight[keys] > 0
    return keys[keep], _sums(keep.astype(np.int64), sizes)


def leaf_centres(texts: DataFrame, weight: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """Centres of the leaves of bisecting k-means over all distinct clause vectors, weighted by their numbers in all texts."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[bytes, int] = {}

        def passed() -> pa.RecordBatch:
            keys = [np.frombuffer(k, np.int32) for k in n]
            return pa.RecordBatch.from_arrays([_list(np.concatenate(keys), np.array([len(k) for k in keys])), pa.array(list(n.values()), pa.int64())], ["keys", "n"])

        for batch in batches:
            keys, sizes = _known(_flat(batch, "keys")[0], _flat(batch, "clauses")[0], weight)
            raw, ends = np.ascontiguousarray(keys, np.int32).tobytes(), (np.cumsum(sizes) * 4).tolist()
            at = 0
            for e in ends:
                if e > at:
                    k = raw[at:e]
                    n[k] = n.get(k, 0) + 1
                    at = e
            if len(n) > 50_000:
                yield passed()
                n.clear()
        if n:
            yield passed()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vectors(weight)
        for batch in batches:
            x = v.of(*_flat(batch, "keys"))
            yield pa.RecordBatch.from_arrays([_list(x.ravel(), np.full(len(x), DIM), pa.float32()), batch.column("n")], ["v", "n"])

    every = texts.select("keys", "clauses").mapInArrow(distinct, "keys array<int>, n bigint").groupBy("keys").agg(F.sum("n").cast("double").alias("n"))
    every = lineage.written(every, "clauses")
    if every.isEmpty():
        return np.zeros((0, DIM), np.float32)
    points = lineage.written(every.select("keys", F.sqrt("n").alias("n")).mapInArrow(project, "v array<float>, n double"), "points")
    points = points.select(array_to_vector(F.col("v").cast("array<double>")).alias("v"), "n").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = BisectingKMeans(k=leaves, featuresCol="v", weightCol="n", maxIter=8, seed=5).fit(points)
    finally:
        points.unpersist()
    return np.array(model.clusterCenters(), dtype=np.float32)


def placed(texts: DataFrame, labels: DataFrame, weight: np.ndarray, centres: np.ndarray) -> DataFrame:
    """(doc_id, keys, n_keys, leaves, n_leaves, aside, subjects): each document by sentence.

    keys are the distinct buckets with a weight of each sentence, n_keys their
    numbers; leaves those of its clauses, n_leaves their numbers; subjects the
    labels of the document, if any.
    """
    half = (centres * centres).sum(1) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, memo = Vectors(weight), {}
        for batch in batches:
            keys, sizes = _known(_flat(batch, "keys")[0], _flat(batch, "clauses")[0], weight)
            n_clauses, n_sentences = _flat(batch, "sentences")
            sentence = np.repeat(np.arange(len(n_clauses)), n_clauses)  # of each clause
            full = np.flatnonzero(sizes)
            raw, ends = np.ascontiguousarray(keys, np.int32).tobytes(), np.cumsum(sizes)
            names = [raw[(e - s) * 4:e * 4] for e, s in zip(ends[full].tolist(), sizes[full].tolist())]
            if len(memo) > 200_000:
                memo.clear()
            new = {}
            for i, k in enumerate(names):
                if k not in memo:
                    new.setdefault(k, i)
            if new:
                at = full[list(new.values())]
                own = np.concatenate([np.arange(e - s, e) for e, s in zip(ends[at].tolist(), sizes[at].tolist())])
                got = np.argmax(v.of(keys[own], sizes[at]) @ centres.T - half, axis=1)
                memo.update(zip(new, got.tolist()))
            leaves = np.array([memo[k] for k in names], np.int32)
            n_leaves = np.bincount(sentence[full], minlength=len(n_clauses))
            pairs = np.unique(np.repeat(sentence, sizes).astype(np.int64) * BUCKETS + keys)
            of, own = pairs // BUCKETS, (pairs % BUCKETS).astype(np.int32)
            n_keys = np.bincount(of, minlength=len(n_clauses))
            doc = lambda x: _sums(x.astype(np.int64), n_sentences)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), _list(own, doc(n_keys)), _list(n_keys, n_sentences), _list(leaves, doc(n_leaves)), _list(n_leaves, n_sentences), batch.column("aside")],
                ["doc_id", "keys", "n_keys", "leaves", "n_leaves", "aside"])

    ints = ", ".join(f"{c} array<int>" for c in ("keys", "n_keys", "leaves", "n_leaves", "aside"))
    # A document has few labels; the join is on the sample's key, and AQE broadcasts the sample only if it is small.
    given = labels.groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))
    return lineage.written(texts.mapInArrow(run, f"doc_id bigint, {ints}").join(given, "doc_id", "left"), "placed")


def _given(batch: pa.RecordBatch, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(documents x subjects 0 or 1 by label, whether a document has labels at all)."""
    place, out, some = {s: i for i, s in enumerate(names)}, np.zeros((batch.num_rows, len(names))), np.zeros(batch.num_rows, bool)
    for j, given in enumerate(batch.column("subjects").to_pylist()):
        if given:
            some[j] = True
            for s in given:
                if s in place:
                    out[j, place[s]] = 1
    return out, some


def leaf_statistics(docs: DataFrame, centres: np.ndarray, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(together, labelled): in how many documents two leaves occur together, and each leaf's documents by label.

    Sums of a leaves x leaves and a leaves x subjects matrix over all documents; each task adds up its own.
    """
    n = len(centres)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, y = np.zeros((n, n)), np.zeros((n, len(names)))
        for batch in batches:
            leaves, sizes = _flat(batch, "leaves")
            x = np.zeros((batch.num_rows, n), np.float32)
            x[np.repeat(np.arange(len(sizes)), sizes), leaves] = 1
            m += x.T @ x
            y += x.T @ _given(batch, names)[0]
        i, j = np.nonzero(m)
        a, c = np.nonzero(y)
        kind = np.repeat([0, 1], [len(i), len(a)])
        yield pa.RecordBatch.from_arrays([pa.array(k, t) for k, t in ((kind, pa.int32()), (np.concatenate([i, a]), pa.int32()), (np.concatenate([j, c]), pa.int32()), (np.concatenate([m[i, j], y[a, c]]), pa.float64()))], ["kind", "i", "j", "x"])

    rows = docs.select("leaves", "subjects").mapInArrow(count, "kind int, i int, j int, x double")
    out = rows.groupBy("kind", "i", "j").agg(F.sum("x").alias("x")).toPandas()  # at most leaves * (leaves + subjects) rows
    together, labelled = np.zeros((n, n)), np.zeros((n, len(names)))
    for kind, target in ((0, together), (1, labelled)):
        o = out[out["kind"] == kind]
        target[o["i"].to_numpy(int), o["j"].to_numpy(int)] = o["x"]
    return together, labelled


def leaf_subjects(together: np.ndarray, labelled: np.ndarray, n_docs: float, rounds: int = 30, keep: float = 0.45) -> np.ndarray:
    """Scores of each leaf for each subject, 0 where a leaf favours none.

    Seeds are how much likelier a label is for documents with the leaf than for
    all. They spread over leaves that occur together more than by chance.
    """
    df = np.maximum(np.diag(together), 1e-9)
    lift = np.log(np.maximum(together, 1e-9) * max(n_docs, 1) / np.outer(df, df))
    w = np.where((together >= 2) & (lift > 0.3), lift * np.sqrt(together / (together + 5)), 0.0)
    np.fill_diagonal(w, 0)
    w /= np.maximum(w.sum(1, keepdims=True), 1e-9)
    given = labelled.sum(1, keepdims=True)
    prior = (labelled.sum(0) + 0.5) / max(labelled.sum() + 0.5 * labelled.shape[1], 1e-9)
    seed = (labelled + SMOOTH * prior) / (given + SMOOTH) - prior
    seed *= given / (given + 2)
    f = seed.copy()
    for _ in range(rounds):
        f = keep * seed + (1 - keep) * (w @ f)
    return f


class Judge:
    """Scores of sentences for each subject: their leaves and their discriminative terms, each about half; leaves alone without leanings."""

    def __init__(self, weight: np.ndarray, leaning: np.ndarray | None, scores: np.ndarray) -> None:
        self.weight, self.leaning, self.leaves = weight, leaning, scores

    def scores(self, batch: pa.RecordBatch) -> np.ndarray:
        keys, n_keys, (leaves, _), n_leaves = _flat(batch, "keys")[0], _flat(batch, "n_keys")[0], _flat(batch, "leaves"), _flat(batch, "n_leaves")[0]
        by_leaf = _sums(self.leaves[leaves], n_leaves)
        if self.leaning is None:
            return by_leaf
        w = self.weight[keys].astype(float)
        by_term = _sums(w[:, None] * self.leaning[keys], n_keys) / np.maximum(_sums(w, n_keys), 1e-9)[:, None]
        return by_leaf / np.maximum(n_leaves, 1)[:, None] * 0.5 + by_term


def term_subjects(docs: DataFrame, weight: np.ndarray, scores: np.ndarray, names: list[str], labelled: float, leaning: np.ndarray | None = None) -> np.ndarray:
    """How far each bucket of terms leans to each subject, BUCKETS x subjects.

    A term is judged by the company of its sentence: the subjects that the leaves
    (and, from the second round, the terms) give to the other sentences of the
    documents, and their labels. Each task adds up arrays of a fixed size.
    """
    k = len(names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, n = np.zeros((BUCKETS, k)), np.zeros(BUCKETS)
        judge = Judge(weight, leaning, scores)
        for batch in batches:
            total, (n_keys, size) = judge.scores(batch), _flat(batch, "n_keys")
            one = np.zeros((len(total), k))
            if len(total):
                sure = np.flatnonzero(total.max(axis=1) >= (LEAST if leaning is not None else LEAST_LEAF))
                one[sure, total[sure].argmax(axis=1)] = 1
            given, some = _given(batch, names)
            every = _sums(one, size) + given * size[:, None]
            company = size - 1 + np.where(some, size, 0)
            w = np.where(some & (size > 1), labelled, 1.0) * (size > 1)
            of = np.repeat(np.arange(len(size)), size)  # the document of each sentence
            value = (every[of] - one) * (w / np.maximum(company, 1))[of, None]
            keys = _flat(batch, "keys")[0]
            at = np.repeat(np.arange(len(total)), n_keys)
            for c in range(k):
                t[:, c] += np.bincount(keys, weights=value[at, c], minlength=BUCKETS)
            n += np.bincount(keys, weights=w[of][at], minlength=BUCKETS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at], pa.float64()), _list(t[at].ravel(), np.full(len(at), k), pa.float64())], ["bucket", "n", "t"])

    got = docs.select("keys", "n_keys", "leaves", "n_leaves", "subjects").mapInArrow(count, "bucket int, n double, t array<double>")
    sums = got.groupBy("bucket").agg(F.sum("n").alias("n"), *[F.sum(F.col("t")[i]).alias(f"t{i}") for i in range(k)]).toPandas()  # at most BUCKETS rows
    out = np.zeros((BUCKETS, k), np.float32)
    if len(sums):
        t, n = sums[[f"t{i}" for i in range(k)]].to_numpy(), sums["n"].to_numpy()[:, None]
        lean = t / n - t.sum(0) / n.sum()
        out[sums["bucket"].to_numpy(int)] = lean * n / (n + 8)
    return out


def assign(docs: DataFrame, weight: np.ndarray, scores: np.ndarray, leaning: np.ndarray | None, names: list[str], share: float = SHARE, least: float = LEAST) -> DataFrame:
    """(doc_id, subject, share): subjects that take up at least the given share of a document's sentences; by leaves alone without leanings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(weight, leaning, scores)
        for batch in batches:
            total, (aside, size) = judge.scores(batch), _flat(batch, "aside")
            kind = np.full(len(total), -1)
            if len(total) and names:
                kind = np.where(total.max(axis=1) >= least, total.argmax(axis=1), -1)
            # A sentence that shares a long run with an item is a passage of it; one without a subject already with a short run.
            live = ~((aside == 2) | (kind < 0) & (aside == 1))
            of = np.repeat(np.arange(len(size)), size)
            of_all = np.bincount(of[live], minlength=len(size))
            some = live & (kind >= 0)
            n = np.bincount(of[some] * max(len(names), 1) + kind[some], minlength=len(size) * max(len(names), 1)).reshape(len(size), -1)
            d, k = np.nonzero((n > 0) & (n >= share * of_all[:, None]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(d)), pa.array([names[i] for i in k], pa.string()), pa.array(n[d, k] / of_all[d], pa.float64())], ["doc_id", "subject", "share"])

    return docs.select("doc_id", "keys", "n_keys", "leaves", "n_leaves", "aside").mapInArrow(run, "doc_id bigint, subject string, share double")


def subjects(docs: DataFrame, labels: DataFrame, areas: DataFrame, items: DataFrame | None = None, leaves: int = LEAVES, share: float = SHARE, terms_too: bool = True) -> DataFrame:
    """(doc_id, subject, share) of the subjects of each document.

    Null and blank texts have no subject, nor have general remarks; passages of
    evaluation items are left aside. Labels of unknown documents or subjects are
    ignored. Ties count for each of the subjects; repeated rows are each given.
    Without labels no document has a subject. Columns other than doc_id and text
    are ignored. areas and items are small lists, read to the driver. With
    terms_too false the leaf mixtures alone decide.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text rlike '[^\\\\s]'")
    names = sorted(r[0] for r in areas.select("subject").where("subject is not null").distinct().collect())
    passages = [] if items is None else [(r["id"], f, r[f]) for r in items.select("id", "q", "rubric").collect() for f in ("q", "rubric") if r[f]]
    texts = parsed(docs, passages)
    weight = term_weights(texts)
    centres = leaf_centres(texts, weight, leaves)
    if not len(centres):
        return docs.sparkSession.createDataFrame([], "doc_id bigint, subject string, share double")
    labels = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "subject")
    by_sentence = placed(texts, labels, weight, centres)
    together, labelled = leaf_statistics(by_sentence, centres, names)
    scores = leaf_subjects(together, labelled, by_sentence.count())
    leaning = None
    for labelled_weight in LABELLED if terms_too else ():
        leaning = term_subjects(by_sentence, weight, scores, names, labelled_weight, leaning)
    return assign(by_sentence, weight, scores, leaning, names, share, LEAST if terms_too else LEAST_LEAF)


def composition(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(subject, n_docs, share_of_docs): how many documents have each subject."""
    total = docs.agg(F.count("*").alias("total"))  # one row
    return found.groupBy("subject").agg(F.countDistinct("doc_id").alias("n_docs")).crossJoin(F.broadcast(total)).select("subject", "n_docs", (F.col("n_docs") / F.col("total")).alias("share_of_docs"))
