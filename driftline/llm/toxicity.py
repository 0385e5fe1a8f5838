"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, votes by distance."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from driftline.llm import bpe
from driftline.llm._tables import Scratch

#: Labelled rows that the model is fitted on, at most: those with the least hash of their id.
MAX_EXAMPLES = 20_000
#: Of these, the rows that are indexed, half of them toxic if there are as many, and those that votes are calibrated on.
INDEXED, CALIBRATED = 2_048, 4_096
#: Beginnings of longer words that are terms too, by letters, spelled with a star.
PREFIXES = (4, 5, 6, 7)
#: A term leans toxic if it is in at least so many toxic examples and so much likelier there (log odds).
MIN_TOXIC, MIN_LOG_ODDS = 3, 2.0
#: Relevance of a word that does not lean; that of a term that leans is 1.
FLOOR = 0.15
NEIGHBOURS = 15
#: Examples of a block, blocks that are summed up first, terms that are columns of the matrix, examples that are compared
#: beside the nearest by exact sums, texts that are scored at once, and stretches of text whose terms a task remembers.
BLOCK, FIRST, COLUMNS, SPARE, SLICE, REMEMBER = 32, 4, 512, 5, 256, 100_000
THRESHOLD = 0.7
FOLDS, HELD_OUT = 3, 1

_WORD = re.compile(r"[^\W\d_]+")


def beginnings(word: str) -> list[str]:
    return [word[:k] + "*" for k in PREFIXES if len(word) > k]


class Terms:
    """The model's vocabulary: words, and beginnings of words that lean toxic, each with a number."""

    def __init__(self, terms: list[str]):
        self.number = {t: i for i, t in enumerate(terms)}
        self.heads = {t[: min(PREFIXES)] for t in terms if t.endswith("*")}
        self.known: dict[str, tuple[int, ...]] = {}

    def _of(self, chunk: str) -> tuple[int, ...]:
        """The numbers of the terms in a stretch without white space."""
        found: list[int] = []
        for word in _WORD.findall(chunk):
            terms = [word, *beginnings(word)] if word[: min(PREFIXES)] in self.heads else [word]
            found += [i for t in terms if (i := self.number.get(t)) is not None]
        if len(self.known) > REMEMBER:
            self.known.clear()
        self.known[chunk] = out = tuple(found)
        return out

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of a text's terms, ascending, and how often each is there."""
        found: dict[int, int] = {}
        known = self.known.get
        for chunk, n in Counter(text.lower().split()).items():
            if (terms := known(chunk)) is None:
                terms = self._of(chunk)
            for i in terms:
                found[i] = found.get(i, 0) + n
        t = np.fromiter(found.keys(), "i8", len(found))
        order = np.argsort(t)
        return t[order], np.fromiter(found.values(), "i8", len(found))[order]


def _ranges(starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places from starts[i] to starts[i + 1] for each i of `which`, and how many each has."""
    size = starts[which + 1] - starts[which]
    ends = np.cumsum(size)
    return np.repeat(starts[which] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0), size


@dataclass
class Index:
    """Examples as vectors of unit length, in blocks. The terms that most examples have are columns of a matrix; each
    other term has postings, the examples that have it, and the largest weight of each block of them."""

    terms: list[str]
    weight: np.ndarray  # by term: its inverse document frequency times its relevance
    ids: list = field(default_factory=list)
    labels: np.ndarray = field(default_factory=lambda: np.zeros(0))
    starts: np.ndarray = field(default_factory=lambda: np.zeros(1, "i8"))  # of each example in the two next
    example_terms: np.ndarray = field(default_factory=lambda: np.zeros(0, "i8"))
    example_weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    column: np.ndarray = field(default_factory=lambda: np.zeros(0, "i8"))  # by term: its column, or -1
    matrix: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), "f4"))  # example x column
    posting_starts: np.ndarray = field(default_factory=lambda: np.zeros(1, "i8"))  # of each term in the two next
    posting_rows: np.ndarray = field(default_factory=lambda: np.zeros(0, "i8"))
    posting_weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    top_starts: np.ndarray = field(default_factory=lambda: np.zeros(1, "i8"))  # of each term in the two next
    top_blocks: np.ndarray = field(default_factory=lambda: np.zeros(0, "i8"))
    top_weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    knots: tuple[np.ndarray, np.ndarray] = (np.zeros(1), np.zeros(1))
    alone: float = 0.0

    def vector(self, t: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Weights of unit length for terms and their counts."""
        w = n * self.weight[t]
        return w / np.sqrt((w * w).sum())

    def build(self, examples: list[tuple[object, int, np.ndarray, np.ndarray]]) -> None:
        """Indexes (id, label, terms, weights); examples of one strongest term lie together, so blocks differ."""
        examples = sorted(examples, key=lambda e: (int(e[2][np.argmax(e[3])]), len(e[2]), str(e[0])))
        self.ids, self.labels = [e[0] for e in examples], np.array([e[1] for e in examples], "f8")
        sizes = np.array([len(e[2]) for e in examples], "i8")
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.example_terms = np.concatenate([e[2] for e in examples] or [np.zeros(0)]).astype("i8")
        self.example_weights = np.concatenate([e[3] for e in examples] or [np.zeros(0)])
        rows = np.repeat(np.arange(len(examples)), sizes)
        common = np.argsort(-np.bincount(self.example_terms, minlength=len(self.terms)), kind="stable")[:COLUMNS]
        self.column = np.full(len(self.terms), -1, "i8")
        self.column[common] = np.arange(len(common))
        own = self.column[self.example_terms]
        self.matrix = np.zeros((len(examples), len(common)), "f4")
        self.matrix[rows[own >= 0], own[own >= 0]] = self.example_weights[own >= 0]
        order = np.flatnonzero(own < 0)
        order = order[np.argsort(self.example_terms[order], kind="stable")]
        term, self.posting_rows, self.posting_weights = self.example_terms[order], rows[order], self.example_weights[order]
        self.posting_starts = np.searchsorted(term, np.arange(len(self.terms) + 1))
        block = self.posting_rows // BLOCK
        first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])])) if len(term) else np.zeros(0, "i8")
        self.top_blocks, self.top_weights = block[first], np.maximum.reduceat(self.posting_weights, first) if len(first) else np.zeros(0)
        self.top_starts = np.searchsorted(term[first], np.arange(len(self.terms) + 1))

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS, but: list[frozenset] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query (terms, weights) the k examples of largest cosine above 0, ties by place: places and cosines.

        Products with the matrix are the common terms' part of all cosines. For the rest, a block's bound is its largest
        such part and, over the other terms, the sum of the largest weights times the query's. The blocks of largest
        bounds are summed up first; then those whose bounds reach the k-th best example so far. `but` names places that
        a query may not have.
        """
        side = np.zeros((len(vectors), self.matrix.shape[1]), "f4")
        for row, (t, w) in enumerate(vectors):
            own = self.column[t]
            side[row, own[own >= 0]] = w[own >= 0]
        common = (side @ self.matrix.T).astype("f8")
        exact, n = np.zeros(len(self.terms)), len(self.ids)
        begins = np.arange(0, n, BLOCK)
        for row, (t, w) in enumerate(vectors):
            score = common[row]
            if but and but[row]:
                score[list(but[row])] = -np.inf
            rare = self.column[t] < 0
            at, size = _ranges(self.top_starts, t[rare])
            bound = np.maximum.reduceat(score, begins) + np.bincount(self.top_blocks[at], np.repeat(w[rare], size) * self.top_weights[at], minlength=len(begins))
            bound = bound * (1 + 1e-5) + 1e-6  # the matrix is rounded
            at, size = _ranges(self.posting_starts, t[rare])
            rows, more = self.posting_rows[at], np.repeat(w[rare], size) * self.posting_weights[at]
            first = np.zeros(len(begins), bool)
            first[np.argpartition(-bound, min(FIRST, len(begins) - 1))[:FIRST]] = True
            some = first[rows // BLOCK]
            score += np.bincount(rows[some], more[some], minlength=n)
            done = np.repeat(first, BLOCK)[:n]
            best = np.sort(score[done])[::-1]
            later = ~first & (bound >= (best[k - 1] if len(best) >= k else -np.inf))
            if later.any():
                some = later[rows // BLOCK]
                score += np.bincount(rows[some], more[some], minlength=n)
                done |= np.repeat(later, BLOCK)[:n]
            # some more than k, since these sums are rounded
            place = np.flatnonzero(done & (score > -np.inf))
            place = place[np.argsort(-score[place], kind="stable")[: k + SPARE]]
            exact[t] = w
            at, size = _ranges(self.starts, place)
            whole = np.add.reduceat(exact[self.example_terms[at]] * self.example_weights[at], np.cumsum(size) - size) if len(place) else np.zeros(0)
            exact[t] = 0
            best = np.lexsort((place, -whole))[:k]
            best = best[whole[best] > 0]
            yield place[best], whole[best]

    def vote(self, place: np.ndarray, score: np.ndarray) -> float:
        """The share of toxic examples among neighbours, each one weighted by its closeness; without neighbours 0."""
        if not len(place):
            return 0.0
        closeness = 1 / (1.05 - np.minimum(score, 1.0))
        return float((closeness * self.labels[place]).sum() / closeness.sum())

    def calibrate(self, votes: np.ndarray, labels: np.ndarray, alone: int, alone_toxic: int) -> None:
        """Fits the chance of label 1 to left-out votes by isotonic regression; that of texts without neighbours by count."""
        self.alone = (alone_toxic + 0.5) / (alone + 50)
        order = np.argsort(votes, kind="stable")
        groups: list[list[float]] = []  # sum of labels, count, sum of votes; one of each kind holds ends off 0 and 1
        for v, y in [(0.0, 0.0), *zip(votes[order].tolist(), labels[order].astype("f8").tolist(), strict=True), (1.0, 1.0)]:
            groups.append([y, 1.0, v])
            while len(groups) > 1 and groups[-2][0] * groups[-1][1] >= groups[-1][0] * groups[-2][1]:
                last = groups.pop()
                groups[-1] = [a + b for a, b in zip(groups[-1], last, strict=True)]
        self.knots = (np.array([g[2] / g[1] for g in groups]), np.array([min(0.999, max(0.001, g[0] / g[1])) for g in groups]))

    def score(self, counts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, list[tuple[object, float]]]]:
        """For texts' terms and counts: the chance that each is toxic, and its nearest examples with their cosines.

        Texts without a term of the examples are as near to all of them: such fitted rows' share is their chance.
        """
        out: list[tuple[float, list[tuple[object, float]]]] = [(self.alone, [])] * len(counts)
        some = [k for k, (t, _) in enumerate(counts) if len(t) and self.ids]
        for k, (place, near) in zip(some, self.nearest([(counts[k][0], self.vector(*counts[k])) for k in some]) if some else (), strict=True):
            if len(place):
                out[k] = float(np.interp(self.vote(place, near), *self.knots)), [(self.ids[p], float(s)) for p, s in zip(place, near, strict=True)]
        return out


def is_held_out(id_col: str) -> Column:
    """The third of ids that no model is fitted on; a null id is not in it."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def _leaning(examples: DataFrame) -> dict[str, float]:
    """Terms that lean toxic with their log odds, from (label, text) rows: how many rows of each label have a term."""

    def terms(wanted: set[str] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bpe.forget()
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    seen: Counter = Counter()
                    for text in batch.column("_text").slice(at, 256).to_pylist():
                        words = set(_WORD.findall(text.lower()))
                        found = words.union(*map(beginnings, words))
                        seen.update(found if wanted is None else found & wanted)
                    yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["term", "n"])

        return run

    totals = {r["_label"]: r["n"] for r in examples.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    counted = lambda label, wanted: examples.where(F.col("_label") == label).select("_text").mapInArrow(terms(wanted), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    # bounded by the fitted rows
    numbers = lambda rows: dict(zip(*(c.to_pylist() for c in rows.toArrow().columns), strict=True))
    in_toxic = numbers(counted(1, None).where(F.col("n") >= min(MIN_TOXIC, max(1, toxic // 3))))
    in_clean = numbers(counted(0, set(in_toxic))) if in_toxic else {}
    odds = {t: float(np.log((n + 0.5) / (toxic + 1)) - np.log((in_clean.get(t, 0) + 0.5) / (clean + 1))) for t, n in in_toxic.items()}
    return {t: o for t, o in odds.items() if o >= MIN_LOG_ODDS}


def relevance(term: str, leaning: dict[str, float]) -> float:
    """How much a term's weight counts: 1 for one that leans toxic, FLOOR for other words."""
    return 1.0 if term in leaning else FLOOR


def counted_terms(docs: DataFrame, terms: list[str], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns to keep of every row, with `_tx_terms` (numbers of the text's terms, ascending) and `_tx_counts`."""
    keep = docs.columns if keep is None else keep
    numbers = T.ArrayType(T.IntegerType())
    read = text_col if text_col in keep else "_tx_text"  # a text that is kept travels once
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("_tx_terms", numbers), T.StructField("_tx_counts", numbers)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe.forget()
        own = Terms(terms)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                found = [own.counts(t or "") for t in part.column(read).to_pylist()]
                ends = np.cumsum([0, *[len(t) for t, _ in found]]).astype("i4")
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([f[k] for f in found]).astype("i4"))) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], *lists], names=schema.names)

    return docs.select(*keep, *([] if read == text_col else [F.col(text_col).alias(read)])).mapInArrow(run, schema)


def _frequencies(counted: DataFrame, n: int) -> np.ndarray:
    """In how many rows of `counted_terms` each of n terms is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, "i8")
        for batch in batches:
            total += np.bincount(batch.column("_tx_terms").flatten().to_numpy(), minlength=n)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "n"])

    df = np.zeros(n)
    # bounded by the fitted rows' words
    found = counted.select("_tx_terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df[found["term"].to_numpy()] = found["n"].to_numpy()
    return df


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Index:
    """Fits the model; see `fit_counted`, which this is without the counted terms."""
    return fit_counted(docs, labels, id_col, text_col, label_col, [])[0]


def fit_counted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", keep: list[str] | None = None) -> tuple[Index, DataFrame]:
    """The model, and `counted_terms` of all rows, written: document frequencies and scores are both made from them.

    The model is fitted on at most MAX_EXAMPLES labelled rows outside the held-out third.

    INDEXED of these rows are the examples: vectors over all their words and the beginnings that lean toxic, weighted by
    term frequency, inverse document frequency over all of `docs`, and relevance, which the fitted rows' labels give.
    CALIBRATED rows, as they come, are left out in turn for the calibration of votes. Labels with a null id or value are
    left out; of several labels of an id the largest holds.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~is_held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_label"))
    order = [F.xxhash64("_id"), F.col("_id")]
    known = known.orderBy(*order).limit(MAX_EXAMPLES)
    rows = docs.select(docs[id_col].alias("_id"), F.coalesce(docs[text_col], F.lit("")).alias("_text"))
    examples = rows.join(F.broadcast(known), "_id")
    leaning = _leaning(examples)

    # at most INDEXED and CALIBRATED ids
    some_toxic = known.where("_label = 1").orderBy(*order).limit(INDEXED // 2)
    some_clean = known.where("_label = 0").orderBy(*order).limit(INDEXED - some_toxic.count())
    indexed = rows.join(F.broadcast(some_toxic.union(some_clean)), "_id")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists: tuple[list, list] = ([], [])
            for text in batch.column("_text").to_pylist():
                found = Counter(_WORD.findall(text.lower()))
                for word, n in list(found.items()):
                    for term in beginnings(word):
                        if term in leaning:
                            found[term] += n
                lists[0].append(list(found.keys()))
                lists[1].append(list(found.values()))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_label"), pa.array(lists[0], pa.list_(pa.string())), pa.array(lists[1], pa.list_(pa.int32()))], names=["id", "label", "terms", "counts"])

    kind = docs.schema[id_col].dataType.simpleString()
    made = indexed.mapInArrow(words, f"id {kind}, label int, terms array<string>, counts array<int>").toArrow()
    # in columns: rows of Python objects would be most of the driver's memory
    made = made.combine_chunks()
    ends = np.cumsum([0, *pc.list_value_length(made["terms"]).to_pylist()])
    flat, flat_counts = (pc.list_flatten(made[c]).combine_chunks() for c in ("terms", "counts"))
    chosen = sorted(flat.unique().to_pylist())

    counted = Scratch(docs.sparkSession).write("terms", counted_terms(docs, chosen, text_col, keep))
    rows_n, df = counted.count(), _frequencies(counted, len(chosen))
    index = Index(chosen, (np.log((rows_n + 1) / (df + 1)) + 1) * np.array([relevance(t, leaning) for t in chosen]))
    own, numbers, n = [], pc.index_in(flat, pa.array(chosen, pa.string())).to_numpy(), flat_counts.to_numpy()
    for i, label, a, b in zip(made["id"].to_pylist(), made["label"].to_pylist(), ends[:-1], ends[1:], strict=True):
        if a < b:
            up = np.argsort(numbers[a:b])
            own.append((i, label, numbers[a:b][up], n[a:b][up]))
    del made, flat, flat_counts, numbers
    own.sort(key=lambda e: (str(e[0]), e[1], e[2].tobytes(), e[3].tobytes()))
    index.build([(i, label, t, index.vector(t, n)) for i, label, t, n in own])
    del own

    places: dict[object, set[int]] = {}
    for p, i in enumerate(index.ids):
        places.setdefault(i, set()).add(p)
    shared = docs.sparkSession.sparkContext.broadcast((index, places))

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe.forget()
        model, own = shared.value
        terms = Terms(model.terms)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                ids, counts = part.column("_id").to_pylist(), [terms.counts(t) for t in part.column("_text").to_pylist()]
                out: list[float | None] = [None] * len(ids)
                some = [k for k, (t, _) in enumerate(counts) if len(t) and model.ids]
                if some:
                    for k, (place, near) in zip(some, model.nearest([(counts[k][0], model.vector(*counts[k])) for k in some], but=[frozenset(own.get(ids[k], ())) for k in some]), strict=True):
                        out[k] = model.vote(place, near) if len(place) else None
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.float64()), part.column("_label")], names=["vote", "label"])

    left_out = rows.join(F.broadcast(known.orderBy(*order).limit(CALIBRATED)), "_id").mapInArrow(votes, "vote double, label int").collect()
    near = sorted((r["vote"], r["label"]) for r in left_out if r["vote"] is not None)
    plain = [r["label"] for r in left_out if r["vote"] is None]
    index.calibrate(np.array([v for v, _ in near]), np.array([y for _, y in near]), len(plain), sum(plain))
    return index, counted


OUTPUTS = ("score", "predicted", "evidence")


def score(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds score, predicted and evidence (example ids and cosines, nearest first) to every row of `docs`.

    Null texts count as empty; texts without a term of the examples get the share of toxic ones among such fitted rows.
    Rows are scored one by one, so ties and repeated rows get equal scores; an empty table stays empty. Input columns
    named like an output are replaced.
    """
    return score_counted(counted_terms(docs, index.terms, text_col, [c for c in docs.columns if c.lower() not in OUTPUTS]), index, docs.schema[id_col].dataType)


def score_counted(counted: DataFrame, index: Index, kind: T.DataType) -> DataFrame:
    """`score` for rows of `counted_terms`, of which the terms go; `kind` is that of the examples' ids."""
    shared = counted.sparkSession.sparkContext.broadcast(index)  # bounded by MAX_EXAMPLES and their texts
    kept = [f for f in counted.schema.fields if f.name not in ("_tx_terms", "_tx_counts")]
    pair = T.StructType([T.StructField("example", kind), T.StructField("cosine", T.DoubleType())])
    schema = T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("evidence", T.ArrayType(pair))])
    id_type = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe.forget()
        model = shared.value
        arrow_pair = pa.list_(pa.struct([("example", id_type), ("cosine", pa.float64())]))
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                terms, counts = (part.column(c) for c in ("_tx_terms", "_tx_counts"))
                ends = np.concatenate([[0], np.cumsum(terms.value_lengths().to_numpy())])
                flat = [c.flatten().to_numpy().astype("i8") for c in (terms, counts)]
                found = model.score([(flat[0][a:b], flat[1][a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)])
                scores = np.array([s for s, _ in found])
                evidence = pa.array([[{"example": i, "cosine": c} for i, c in e] for _, e in found], arrow_pair)
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in kept], pa.array(scores), pa.array((scores >= THRESHOLD).astype("i4")), evidence], names=schema.names)

    return counted.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Fits on `labels` and scores all rows of `docs`; see `fit_counted` and `score`. Without labels every score is 0.01.

    Terms of a text are counted once, in one pass whose result is written; `keep` names the columns that come out, else
    all do, the text included.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in OUTPUTS]
    index, counted = fit_counted(docs, labels, id_col, text_col, keep=keep)
    return score_counted(counted, index, docs.schema[id_col].dataType)
