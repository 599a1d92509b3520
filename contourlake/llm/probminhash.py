"""MinHash near-dedup with ProbMinHash sketches, banding and exact verification.

A document is the weighted set of its shingles of five words, the weight being
how often a shingle occurs. Every shingle sends a Poisson process of arrivals,
at the rate of its weight, to the registers of a sketch; a register keeps the
shingle that arrives first. Two sketches agree in a register with a probability
that is the probability Jaccard similarity of the sets. A process stops when its
time passes the largest time in any register, so most shingles arrive once.

Documents with equal words are one vertex from the start. Documents that share
a band are candidates; each is verified on its whole shingle sets. Bands are not
expanded to all pairs: members are first compared with the smallest of their
bands; what that leaves in different components is compared where documents
share one of their rarest shingles, as all similar ones do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_rows, forget, met, mix64, numbered, renamed, row_groups, table, text_buffers, written
from .components import connected_components
from .words import rows_of_shingles, weighted_shingles, word_hashes

SHINGLE, SIMILARITY = 5, 0.8
#: Bands and registers in each: two documents of similarity 0.8 share no band with a probability of about 5e-6.
#: Six registers keep documents apart that only have a passage in common, of which a large corpus has very many.
BANDS, ROWS = 40, 6
REGISTERS = BANDS * ROWS
#: Arrivals that are drawn at once, where so many processes do not run.
DRAWS = 8192
_STEP = np.uint64(0x9E3779B97F4A7C15)


def sketches(row: np.ndarray, shingles: np.ndarray, weights: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """The shingle in each register of each of n rows; zeros for an empty set. row: the row of each shingle, ascending."""
    held = np.zeros(n * registers, np.uint64)
    best = np.full(n * registers, np.inf)
    who, base, rate, time, drawn = shingles, mix64(shingles), weights.astype(float), np.zeros(len(shingles)), 0
    while len(who):
        # few processes are left of short texts, which need many arrivals: these are drawn together
        many = min(64, max(1, DRAWS // len(who)))
        state = mix64(base[:, None] + np.arange(drawn + 1, drawn + many + 1, dtype=np.uint64) * _STEP)
        drawn += many
        # the low bits pick the register, the high ones the waiting time
        waits = -np.log(((state >> np.uint64(11)).astype(float) + 1.0) * 2.0**-53) / rate[:, None]
        times = np.cumsum(np.hstack((time[:, None], waits)), axis=1)[:, 1:]
        spot = row[:, None] * registers + ((state & np.uint64(0xFFFF)) * np.uint64(registers) >> np.uint64(16)).astype(np.int64)
        np.minimum.at(best, spot.ravel(), times.ravel())
        won = times == best[spot]
        held[spot[won]] = np.broadcast_to(who[:, None], won.shape)[won]
        first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        latest = np.repeat(best.reshape(n, registers)[row[first]].max(axis=1), np.diff(np.append(first, len(row))))
        time = times[:, -1]
        alive = time < latest
        row, who, base, rate, time = row[alive], who[alive], base[alive], rate[alive], time[alive]
    return held.reshape(n, registers)


def sketch(shingles: np.ndarray, weights: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """The shingle in each register of one set."""
    return sketches(np.zeros(len(shingles), np.int64), shingles, weights, 1, registers)[0]


def probability_jaccard(a: np.ndarray, u: np.ndarray, b: np.ndarray, v: np.ndarray) -> float:
    """The exact similarity of two weighted sets, given as ascending members with their weights.

    The sum over common members i of 1 / sum over all j of max(u_j / u_i, v_j / v_i).
    """
    if len(a) == 0 or len(b) == 0:
        return 0.0
    common, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(common) == 0:
        return 0.0
    x, y = u[i].astype(float), v[j].astype(float)
    ratio = x / y
    # members with a larger ratio than i count by u, the others by v
    order = np.argsort(ratio, kind="stable")
    ratio, x, y = ratio[order], x[order], y[order]
    below_y = np.concatenate(([0.0], np.cumsum(y)))
    above_x = np.concatenate(([0.0], np.cumsum(x)))
    at = np.searchsorted(ratio, ratio, side="right")
    only_a, only_b = float(u.sum()) - x.sum(), float(v.sum()) - y.sum()
    return float((1.0 / ((only_a + above_x[-1] - above_x[at]) / x + (only_b + below_y[at]) / y)).sum())


def _sketched(docs: DataFrame) -> DataFrame:
    """(doc, same, bands) for rows with words: a 128-bit hash of all words in order, and the hash of each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            rows, same, bands = [], [], []
            for i, j in row_groups(offsets):
                words, at = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                n = np.diff(at)
                held = np.flatnonzero(n)
                if not len(held):
                    continue
                place = (np.arange(len(words)) - np.repeat(at[:-1], n)).astype(np.uint64) * _STEP
                one, two = (np.add.reduceat(mix64((words ^ salt) + place), at[:-1][held], dtype=np.uint64) for salt in (np.uint64(0), np.uint64(0x5BD1E995)))
                grid = sketches(*rows_of_shingles(words, at, SHINGLE), j - i)[held].reshape(len(held), BANDS, ROWS)
                band = np.tile(np.arange(BANDS, dtype=np.uint64), (len(held), 1))
                for r in range(ROWS):
                    band = mix64(band * _STEP + grid[:, :, r])
                rows.extend((held + i).tolist())
                same.extend(x.tobytes() + y.tobytes() for x, y in zip(one, two, strict=True))
                bands.append(band.view(np.int64).ravel())
            flat = pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(same, pa.binary()), lists], names=["doc", "same", "bands"])

    return docs.mapInArrow(run, "doc long, same binary, bands array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar; each side's text comes by a join on its id."""
    left = texts.select(F.col("doc").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("doc").alias("b"), F.col("text").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple] = {}
        for batch in batches:
            found = []
            data, offsets = [None, None], [None, None]
            for side in (0, 1):
                data[side], offsets[side] = text_buffers(batch.column(2 + side))
            ids = [batch.column(0).to_pylist(), batch.column(1).to_pylist()]
            for k in range(batch.num_rows):
                sets = []
                for side in (0, 1):
                    own = kept.get(ids[side][k])
                    if own is None:
                        part = data[side][offsets[side][k] : offsets[side][k + 1]]
                        own = weighted_shingles(word_hashes(part, np.array([0, len(part)]))[0], SHINGLE)
                        if len(kept) > 256:
                            kept.clear()
                        kept[ids[side][k]] = own
                    sets.append(own)
                found.append(probability_jaccard(*sets[0], *sets[1]) >= least)
            yield batch.select([0, 1]).filter(pa.array(found, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _compared(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    with arrow_rows(pairs.sparkSession, 500):
        return written(_verified(pairs, texts, least))


#: 64-bit words of the bitmap of a document's shingles.
MAP = 32


def _crossing(members: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(a, b), a > b: every pair of members (doc, c) in different components c that may be similar enough.

    The similarity is at most the common weight of two sets, as shares of one.
    So a document loses no link by its rarest shingles of a weight of 1 - least
    and a little more: similar ones share one of these. Shingles that only one
    component has are rarer than all others and join with none, so a document
    that has too many of them is done at once. Pairs are then bounded by
    1 / (1 + x / (1 - x) + y / (1 - y)), x and y being the shares of either set
    that the other lacks: where two documents meet by the rarest shingle they
    share, at least what each has of rarer ones, and what bitmaps show.
    """

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            maps, totals = np.zeros((batch.num_rows, MAP * 64), bool), np.zeros(batch.num_rows, np.int64)
            for k in range(batch.num_rows):
                part = data[offsets[k] : offsets[k + 1]]
                own, weight = weighted_shingles(word_hashes(part, np.array([0, len(part)]))[0], SHINGLE)
                maps[k, (own % np.uint64(MAP * 64)).astype(np.int64)] = True
                totals[k] = weight.sum()
            words = np.packbits(maps, axis=1, bitorder="little").view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals), *(pa.array(words[:, k]) for k in range(MAP))], names=["doc", "total", *(f"b{k}" for k in range(MAP))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            sets = [weighted_shingles(word_hashes(data[offsets[k] : offsets[k + 1]], np.array([0, offsets[k + 1] - offsets[k]]))[0], SHINGLE) for k in range(batch.num_rows)]
            for i in range(0, batch.num_rows, 64):
                some = sets[i : i + 64]
                at = np.repeat(np.arange(i, i + len(some)), [len(x[0]) for x in some])
                found = np.concatenate([x[0] for x in some]).view(np.int64)
                weight = np.concatenate([x[1] / max(1, x[1].sum()) for x in some])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(found), pa.array(weight)], names=["doc", "c", "shingle", "weight"])

    slack = 1e-9
    whole = members.join(texts, "doc").select("doc", "c", "text")
    sets = whole.mapInArrow(run, "doc long, c long, shingle long, weight double")
    live = written(sets.groupBy("shingle").agg(F.count("*").alias("n"), F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("shingle", "n", F.col("n").alias("often")))
    rows = met(sets, live, ["shingle"], ["doc"])
    by = Window.partitionBy("doc")
    alive = F.sum("weight").over(by)
    before = F.coalesce(F.sum("weight").over(by.orderBy("often", "shingle").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rarer = 1 - F.col("alive") + F.col("before")
    head = written(rows.withColumn("alive", alive).withColumn("before", before).where((F.col("alive") >= least - slack) & (rarer <= 1 - least + slack)).select("doc", "c", "shingle", F.greatest(rarer, F.lit(0.0)).alias("rarer")))
    left = head.select("doc").distinct()
    maps = whole.join(left, "doc", "left_semi").mapInArrow(bits, "doc long, total long, " + ", ".join(f"b{k} long" for k in range(MAP))).dropDuplicates(["doc"])
    full = written(head.join(maps, "doc"))
    forget(live, head)
    lacks = lambda s, t, n: " + ".join(f"bit_count({s}.b{k} & ~{t}.b{k})" for k in range(n))
    share = lambda s, t, n: F.expr(f"cast({lacks(s, t, n)} as double) / {s}.total")
    maps_lack = lambda n: (share("p", "q", n), share("q", "p", n))  # noqa: E731  a third of the maps shows most pairs to differ
    bound = lambda x, y: x / F.greatest(1 - x, F.lit(slack)) + y / F.greatest(1 - y, F.lit(slack)) <= 1 / least - 1 + slack
    pairs = full.alias("p").join(full.alias("q"), F.expr("p.shingle = q.shingle and p.doc > q.doc and p.c != q.c") & bound(F.col("p.rarer"), F.col("q.rarer")) & bound(*maps_lack(MAP // 3)) & bound(*maps_lack(MAP)))
    return pairs.select(F.col("p.doc").alias("a"), F.col("q.doc").alias("b")).distinct()


def near_duplicates(docs: DataFrame, least: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id) for each row of docs: the smallest id that verified links lead to.

    Rows with one id are one document, with the text that has the smallest hash;
    rows without an id get a null class. Texts without words link with nothing. Documents of equal words have one
    class without being compared. Ids are of any type that can be sorted. Other
    columns are not read; an empty table gives no rows.
    """
    source, names = numbered(docs.select(*dict.fromkeys((id_col, text_col))), id_col, "__doc")
    source = source.select(F.col("__doc").alias("doc"), F.col(f"`{text_col}`").alias("text"))
    known = source.where("doc is not null")
    # a document has one text; ids that repeat are looked for without reading texts
    again = written(known.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select("doc"))
    if not again.isEmpty():
        least_text = known.join(again, "doc", "left_semi").groupBy("doc").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
        known = written(known.join(again, "doc", "left_anti").unionByName(least_text))
    drawn = written(_sketched(known))
    heads = written(drawn.groupBy("same").agg(F.min("doc").alias("head"), F.min_by("bands", "doc").alias("bands"), F.count("*").alias("n")))
    several = heads.where("n > 1").select("same", "head", "n")
    copies = written(met(drawn.select("doc", "same"), several, ["same"], ["doc"]).where("doc != head").select(F.col("doc").alias("a"), F.col("head").alias("b")))
    bands = written(heads.select(F.col("head").alias("doc"), F.posexplode("bands").alias("band", "value")).select("doc", F.xxhash64("band", "value").alias("band")))
    forget(drawn, heads)
    sizes = written(bands.groupBy("band").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where("n > 1"))
    shared = written(met(bands, sizes, ["band"], ["doc"]))
    forget(bands, sizes)
    # texts are shuffled once, at every size alike; what follows reads candidates only
    texts = written(known.join(shared.select("doc").distinct().hint("merge"), "doc", "left_semi"))
    # first each document against the first ones of its bands
    one = written(shared.where("doc != first").select(F.col("doc").alias("a"), F.col("first").alias("b")).distinct())
    links = _compared(one, texts, least)
    labels = connected_components(links.unionByName(copies))
    # then what bands still hold in different components and was not compared
    own = written(shared.join(labels.withColumnRenamed("id", "doc"), "doc", "left").select("band", "doc", F.coalesce("component", "doc").alias("c")))
    mixed = written(own.groupBy("band").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("n")).where("low < high").select("band", "n"))
    left = written(met(own, mixed, ["band"], ["doc"]).select("doc", "c").distinct())
    last = _compared(_crossing(left, texts, least).join(one, ["a", "b"], "left_anti"), texts, least)
    forget(texts, shared, own, mixed, left)
    # the last links join components so far: a graph of these alone
    ends = [labels.select(F.col("id").alias(e), F.col("component").alias(f"c{e}")) for e in "ab"]
    across = last.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    roots = connected_components(across).select(F.col("id").alias("component"), F.col("component").alias("root"))
    classes = labels.join(roots, "component", "left").select("id", F.coalesce("root", "component").alias("component"))
    classes = classes.unionByName(roots.select(F.col("component").alias("id"), F.col("root").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))
    out = source.select(F.col("doc").alias("id")).join(classes, "id", "left").select(F.col("id").alias(id_col), F.coalesce("component", "id").alias("class_id"))
    return renamed(out, [id_col, "class_id"], names)


def keep_one(docs: DataFrame, least: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each class, the one with the smallest id.

    Rows without an id stay; of the rows with one id the one whose text has the
    smallest hash stays. Texts without words are no copies of each other; an
    empty table gives an empty table.
    """
    classes = written(near_duplicates(docs, least, id_col, text_col).where(F.col("class_id") != F.col(id_col)).select(id_col).distinct())
    known = docs.where(F.col(id_col).isNotNull()).join(classes, id_col, "left_anti")
    first = known.groupBy(id_col).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.xxhash64(*[F.col(f"`{c}`") for c in (text_col, *docs.columns)])).alias("__row"))
    return first.select("__row.*").unionByName(docs.where(F.col(id_col).isNull()))


def op7_near_dedup(spark, sf_dir):
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))
