"""Near-duplicate groups by b-bit MinHash with exact confirmation on the full shingle sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordIds, append_columns, free_names, lower_words, saved, ship, small_batches, text_steps, tidy

WORDS, HASHES, BANDS, BITS = 5, 128, 32, 4
#: Links need 100 * intersection >= NEAR * union.
NEAR = 75
#: Estimates this far below are still confirmed: five standard deviations of an estimate from 128 hashes at 0.75.
CUTOFF = 0.55
#: Members of a group, and shingles of theirs, that a task compares with as many others at a time.
BLOCK, BLOCK_SHINGLES = 8192, 2_000_000
#: Rows of a join that share a key go to as many tasks as they hold this number.
HEAVY = 2000
#: Ids are broadcast up to this count (8 bytes each) and joined by shuffle beyond.
BROADCAST_IDS = 2_000_000
_rng = np.random.default_rng(20_240)
_XOR = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)
_ODD = _rng.integers(0, 2**32, HASHES, dtype=np.uint32) | np.uint32(1)
_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Texts -> sorted distinct 64-bit hashes of their shingles of five words (or of all words, if fewer)."""

    def __init__(self):
        self.words = WordIds(lambda new: np.fromiter((xxhash.xxh3_64_intdigest(w) for w in new), np.uint64, len(new)))

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        lists = [lower_words(t) for t in texts]
        flat = [w for x in lists for w in x]
        if not flat:
            return [np.empty(0, np.uint64) for _ in texts]
        at = self.words.lookup(flat)
        h = self.words.table[at]
        n = len(h)
        with np.errstate(over="ignore"):
            g = h.copy()
            for k in range(1, WORDS):
                g[: n - k] = g[: n - k] * _P + h[k:]
                if n - k <= 0:
                    break
            g = _mix(g)
            out, start = [], 0
            for x in lists:
                end = start + len(x)
                if len(x) >= WORDS:
                    out.append(np.unique(g[start : end - WORDS + 1]))
                elif x:
                    v = np.uint64(len(x))
                    for w in h[start:end]:
                        v = v * _P + w
                    out.append(_mix(np.array([v], np.uint64)))
                else:
                    out.append(np.empty(0, np.uint64))
                start = end
        return out


def set_key(s: np.ndarray) -> tuple[int, int]:
    """A sorted set's own 128 bits, as two signed words."""
    return tuple(int(x) for x in np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64))


def minima(s: np.ndarray) -> np.ndarray:
    """The 128 minima of a set's hashes."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 2**32 - 1, np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(out, ((x[i : i + 2048, None] ^ _XOR) * _ODD).min(axis=0), out=out)
    return out


def low_bits(m: np.ndarray) -> np.ndarray:
    """The low BITS bits of minima (a row per set) as BITS * 2 64-bit words: word 2j + i has bit j of half i."""
    planes = [np.packbits((m >> np.uint32(j)) & np.uint32(1), axis=1).view(np.int64) for j in range(BITS)]
    return np.concatenate(planes, axis=1)


def band_keys(m: np.ndarray) -> np.ndarray:
    r = HASHES // BANDS
    with np.errstate(over="ignore"):
        h = np.arange(BANDS, dtype=np.uint64) + np.zeros((len(m), 1), np.uint64)
        for k in range(r):
            h = _mix(h * _P + m[:, k::r].astype(np.uint64))
    return h.view(np.int64)


def estimate(matches: Column) -> Column:
    """Similarity from the share of equal low bits, less what equals by chance."""
    c = 2.0**-BITS
    return (matches / F.lit(float(HASHES)) - c) / (1 - c)


def matching(a: Column, b: Column) -> Column:
    """How many of two packed signatures' values are equal, by bit counts."""
    halves = []
    for i in (0, 1):
        differ = None
        for j in range(BITS):
            x = a[2 * j + i].bitwiseXOR(b[2 * j + i])
            differ = x if differ is None else differ.bitwiseOR(x)
        halves.append(F.bit_count(differ))
    return F.lit(HASHES) - halves[0] - halves[1]


_SIGNED = [T.StructField("n", T.LongType()), T.StructField("hi", T.LongType()), T.StructField("lo", T.LongType()), T.StructField("sig", T.ArrayType(T.LongType())), T.StructField("bands", T.ArrayType(T.LongType()))]


def signatures(docs: DataFrame) -> DataFrame:
    """(id, n, hi, lo, sig, bands) of (id, text): set size, the set's own 128-bit key, packed low bits, band keys."""

    def make():
        shingler = Shingler()

        def on_texts(texts):
            seen: dict[str | None, int] = {}
            which = [seen.setdefault(t, len(seen)) for t in texts]  # copies are signed once
            sets = shingler.sets(list(seen))
            m = np.stack([minima(s) for s in sets])
            bits, bands = low_bits(m).tolist(), band_keys(m).tolist()
            rows = [(len(s), *set_key(s), b if len(s) else None, d if len(s) else None) for s, b, d in zip(sets, bits, bands, strict=True)]
            return [list(x) for x in zip(*(rows[k] for k in which), strict=True)]

        return on_texts

    return append_columns(docs, "text", _SIGNED, make).drop("text")


def _small(df: DataFrame) -> DataFrame:
    """A saved narrow table for a join: broadcast only while it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def with_ids(df: DataFrame, id_col: str, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join on a saved table of ids (column "id"), broadcast only while it is small."""
    return df.join(_small(ids), F.col(id_col) == F.col("id"), how)


def heavy_keys(counts: DataFrame, *keys: str) -> DataFrame:
    """(keys, parts) of the keys with over HEAVY rows: to how many tasks their rows are dealt. counts: (keys, m)."""
    return _small(saved(counts.where(F.col("m") > HEAVY).select(*keys, F.ceil(F.col("m") / HEAVY).alias("parts"))))


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], by: str, heavy: DataFrame, how: str = "inner") -> DataFrame:
    """left joined with right, which has one row per key; the rows of a heavy key are dealt out by the hash of `by`,
    and right's row is copied for each part. heavy: heavy_keys of left."""
    many = F.coalesce("parts", F.lit(1).cast("long"))
    one = left.join(heavy, keys, "left").withColumn("part", F.pmod(F.xxhash64(by), many)).drop("parts")
    other = right.join(heavy, keys, "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), many - 1))).drop("parts")
    return one.join(other, [*keys, "part"], how).drop("part")


def _rows_of(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("m"))


def shingle_sets(docs: DataFrame, reps: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, set) of a saved table of nodes (column "node"): the texts of their representatives' ids are shingled
    again, and the sets with the nodes' keys are kept, so that it doesn't matter which texts share an id."""
    schema = T.StructType([T.StructField("hi", T.LongType()), T.StructField("lo", T.LongType()), T.StructField("set", T.ArrayType(T.LongType()))])

    def run(batches):
        shingler = Shingler()
        with tidy():
            for b in batches:
                for _, _, texts in text_steps(b.column(0)):
                    sets = shingler.sets(texts)
                    keys = [set_key(x) for x in sets]
                    yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["hi", "lo", "set"])

    ship(docs.sparkSession)
    small_batches(docs.sparkSession)
    needed = saved(reps.select("node", "rep", "hi", "lo").join(_small(nodes), "node", "left_semi"))
    ids = saved(needed.select(F.col("rep").alias("id")).distinct())
    texts = with_ids(docs.select(F.col("id").alias("key"), "text"), "key", ids, "left_semi").select("text")
    return texts.mapInArrow(run, schema).dropDuplicates(["hi", "lo"]).join(needed, ["hi", "lo"]).select("node", "set")


def confirmed(docs: DataFrame, reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """The saved pairs (a, b) whose full shingle sets are near."""
    sets = saved(shingle_sets(docs, reps, saved(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())))
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    both = spread_join(both, sets.select(F.col("node").alias("a"), F.col("set").alias("x")).join(_small(saved(pairs.select("a").distinct())), "a", "left_semi"), ["a"], "b", heavy_keys(_rows_of(pairs, "a"), "a"))
    common = F.size(F.array_intersect("x", "y"))
    return saved(both.withColumn("k", common).where(100 * F.col("k") >= NEAR * (F.size("x") + F.size("y") - F.col("k"))).select("a", "b"))


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in the links (a, b): the smallest id reachable.

    Each turn takes the least label of the neighbours and then the label's own label; turns grow as the logarithm of
    a component's width. Turns are written to the shared folder. Neither the links of one node nor the nodes of one
    label meet in one task.
    """
    edges = saved(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    wide = heavy_keys(_rows_of(edges, "b"), "b")
    labels = saved(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")))
    while True:
        near = spread_join(edges, labels.select(F.col("id").alias("b"), "component"), ["b"], "a", wide).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        step = saved(labels.join(near, "id").select("id", F.least("component", "m").alias("to"), F.col("component").alias("was")))
        jump = labels.select(F.col("id").alias("to"), F.col("component").alias("further"))
        new = saved(spread_join(step, jump, ["to"], "id", heavy_keys(_rows_of(step, "to"), "to")).select("id", F.least("to", "further").alias("component"), "was"))
        changed = new.where("component <> was").limit(1).count()
        labels = new.select("id", "component")
        if not changed:
            return labels


class _Merge:
    """Which of the components in a pair of blocks have met."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        self.left, self.right = left.copy(), right.copy()

    def join(self, a: int, b: int) -> None:
        for side in (self.left, self.right):
            side[side == b] = a


def _estimates(sig: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity of one packed signature with others, by bit counts of unsigned words."""
    differ = np.zeros((len(others), 2), np.uint64)
    for j in range(BITS):
        differ |= sig[2 * j : 2 * j + 2] ^ others[:, 2 * j : 2 * j + 2]
    equal = HASHES - np.bitwise_count(differ).sum(axis=1).astype(np.int64)
    return (equal / HASHES - 2.0**-BITS) / (1 - 2.0**-BITS)


def _possible(k: int, left: dict, right: dict, met: _Merge) -> np.ndarray:
    """Members of the right block that the left one's k-th may be linked with: unlike component, fitting size, estimate; the nearest first."""
    n, m = left["n"][k], right["n"]
    at = np.flatnonzero((met.left[k] != met.right) & (100 * np.minimum(n, m) >= NEAR * np.maximum(n, m)))
    if len(at):
        est = _estimates(left["sig"][k], right["sig"][at])
        ok = est >= CUTOFF
        at = at[ok][np.argsort(-est[ok], kind="stable")]
    return at


def _candidate_edges(left: dict, right: dict) -> list[tuple[int, int]]:
    """Components with a possible link, as a spanning forest of them."""
    met, out = _Merge(left["component"], right["component"]), []
    for k in range(len(left["n"])):
        at = _possible(k, left, right, met)
        while len(at):
            out.append((int(left["component"][k]), int(right["component"][at[0]])))
            met.join(met.left[k], met.right[at[0]])
            at = at[met.right[at] != met.left[k]]
    return out


def _links(left: dict, right: dict) -> list[tuple[int, int]]:
    """Confirmed links between components, as a spanning forest: a pair is compared on full sets unless it has met already."""
    met, out = _Merge(left["component"], right["component"]), []
    for k in range(len(left["n"])):
        at, size = _possible(k, left, right, met), 8
        mine = left["set"][k]
        while len(at):
            part, at = at[:size], at[size:]
            size = 256
            sets = [right["set"][i] for i in part]
            flat = np.concatenate(sets)
            where = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
            many = np.array([len(x) for x in sets])
            common = np.add.reduceat((mine[where] == flat).astype(np.int64), np.cumsum(many) - many)
            for i in part[100 * common >= NEAR * (len(mine) + many - common)]:
                if met.right[i] != met.left[k]:
                    out.append((int(left["id"][k]), int(right["id"][i])))
                    met.join(met.left[k], met.right[i])
            at = at[met.right[at] != met.left[k]]
    return out


def dealt_blocks(members: DataFrame, by: str) -> DataFrame:
    """Members dealt to pairs of blocks (i, j) of their group. A group's blocks hold about BLOCK members each, or
    BLOCK_SHINGLES if that is less, so that a group of G members makes G * (1 + G / BLOCK) rows; groups of fewer are one block."""
    sizes = saved(members.groupBy(by).agg(F.count(F.lit(1)).alias("m"), F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks")).where("m > 1"))
    here = spread_join(members, sizes.select(by, "blocks"), [by], "id", heavy_keys(sizes, by)).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    here = here.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return here.select(F.col(by).alias("key"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", *[c for c in members.columns if c != by])


def _in_blocks(members: DataFrame, by: str, compare) -> DataFrame:
    """Pairs (a, b) that compare(left, right) finds in each pair of blocks of members with one value of `by`.

    The rows are dealt by pair of blocks and sorted, so that a task passes through its pairs one after another; a
    task holds the members of one pair at a time, whatever the size of the group.
    """
    dealt = dealt_blocks(members, by).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    names = [c for c in dealt.columns if c not in ("key", "i", "j")]

    def columns(rows: pa.Table) -> dict:
        out = {}
        for c in names:
            col = rows.column(c).combine_chunks()
            if isinstance(col, pa.ChunkedArray):
                col = col.chunk(0)
            if c == "sig":
                out[c] = col.flatten().to_numpy().view(np.uint64).reshape(len(col), -1)
            elif c == "set":
                flat, at = col.flatten().to_numpy().view(np.uint64), np.r_[0, np.cumsum(col.value_lengths().to_numpy())]
                out[c] = [flat[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]
            else:
                out[c] = col.to_numpy()
        return out

    def pick(cols: dict, rows: np.ndarray) -> dict:
        return {c: [v[i] for i in rows] if isinstance(v, list) else v[rows] for c, v in cols.items()}

    def found(rows: pa.Table, i: int, j: int) -> list[tuple[int, int]]:
        if rows.num_rows < 2:
            return []
        cols = columns(rows)
        if i == j:
            return compare(cols, cols)
        return compare(pick(cols, np.flatnonzero(cols["block"] == i)), pick(cols, np.flatnonzero(cols["block"] == j)))

    def run(batches):
        held: list[pa.Table] = []
        last = None

        def flush():
            got = found(pa.concat_tables(held), last[1], last[2])
            return pa.RecordBatch.from_arrays([pa.array([min(p) for p in got], pa.int64()), pa.array([max(p) for p in got], pa.int64())], names=["a", "b"])

        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)], 1)
            cuts = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, len(keys)] if len(keys) else [0]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                now = tuple(keys[x].tolist())
                if last is not None and now != last:
                    if (out := flush()).num_rows:
                        yield out
                    held = []
                last = now
                held.append(pa.Table.from_batches([batch.slice(x, y - x)]))
        if held and (out := flush()).num_rows:
            yield out

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _open_buckets(named: DataFrame) -> DataFrame:
    """Members of the buckets with several components; of buckets with the same members, one."""
    word = F.xxhash64("id").cast("decimal(20,0)")
    told = named.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sum(word).alias("h"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("x"), F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most")
    told = saved(told.groupBy("m", "h", "x").agg(F.min("key").alias("key")))
    return spread_join(named, told.select("key"), ["key"], "id", heavy_keys(told, "key"))


def rest_of_links(docs: DataFrame, reps: DataFrame, buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Links between the components of `labels` that share a bucket of `buckets` (key, node).

    Components are first brought together by estimates of pairs that share a bucket; within such a family, all pairs
    of unlike components that the estimate doesn't rule out are compared on full sets.
    """
    names = reps.select(F.col("node").alias("id"), "n", "sig").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    named = saved(buckets.select("key", F.col("node").alias("id")).join(names, "id"))
    edges = saved(_in_blocks(_open_buckets(named), "key", _candidate_edges))
    if edges.isEmpty():
        return edges
    family = components(edges).withColumnRenamed("component", "family")
    members = saved(names.join(family.withColumnRenamed("id", "component"), "component"))
    sets = shingle_sets(docs, reps, saved(members.select(F.col("id").alias("node")))).withColumnRenamed("node", "id")
    return saved(_in_blocks(members.join(sets, "id"), "family", _links))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row.

    Documents with equal shingle sets form a class, told by a 128-bit key, which is a node of the graph. Nodes meet in
    the buckets of 32 bands of 4 minima (a pair at 0.75 meets with probability 1 - 5e-6). Every pair is first estimated
    from the packed low bits and then confirmed on full sets. In each bucket, all members are compared with the one of
    the smallest number first, which joins most groups of copies at linear cost. What buckets still hold several
    components is compared in pairs of blocks of bounded size, where only pairs that aren't connected yet are looked
    at; a pair of blocks returns a spanning forest of its links. So no link between components is lost and no bucket
    is cut off. Rows grow with the documents, but for groups of over BLOCK members that share a bucket and are
    not linked with one another: of G such, G * G / BLOCK rows are dealt out, and all pairs are estimated.

    A null, empty or blank text has no shingles and is linked with nothing. A null id takes no part and is kept with
    a null component. Rows that share an id are linked by their own texts each, and repeated rows get equal results.
    An empty table gives no rows; other columns aren't read.
    """
    out = _groups(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "kept")


def _groups(docs: DataFrame) -> DataFrame:
    """(id, word, n, component_id, kept) of every row (id, text); word is a hash of the text."""
    signed = saved(signatures(docs.withColumn("word", F.xxhash64("text"))))
    worded = signed.where("n > 0 AND id IS NOT NULL")
    classes = worded.groupBy("hi", "lo", "n").agg(*[F.any_value(c).alias(to) for c, to in (("id", "rep"), ("sig", "sig"), ("bands", "bands"))], F.count(F.lit(1)).alias("m"))
    reps = saved(classes.withColumn("node", F.monotonically_increasing_id()))
    banded = reps.select("node", F.explode("bands").alias("key"))
    met = saved(banded.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("node").alias("pivot")).where("m > 1"))
    buckets = saved(spread_join(banded, met.select("key", "pivot"), ["key"], "node", heavy_keys(met, "key")))
    sigs = reps.select("node", "sig")
    stars = saved(buckets.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct())
    near = stars.join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("y")), "b")
    near = spread_join(near, sigs.select(F.col("node").alias("a"), F.col("sig").alias("x")), ["a"], "b", heavy_keys(_rows_of(stars, "a"), "a"))
    near = saved(near.where(estimate(matching(F.col("x"), F.col("y"))) >= CUTOFF).select("a", "b"))
    links = confirmed(docs, reps, near)
    more = rest_of_links(docs, reps, buckets, components(links))
    labels = components(links.unionByName(more)).withColumnRenamed("id", "node")
    of_class = reps.select("node", "hi", "lo", "n").join(labels, "node", "left").select("hi", "lo", "n", F.coalesce("component", "node").alias("component"))
    copies = heavy_keys(reps.select("hi", "lo", "n", "m"), "hi", "lo", "n")
    out = saved(spread_join(worded.select("id", "word", "n", "hi", "lo"), of_class, ["hi", "lo", "n"], "id", copies).select("id", "word", "n", "component"))
    # Components of one document have no row in `least`; that document is their first.
    least = saved(out.groupBy("component").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1"))
    out = spread_join(out, least.select("component", "first"), ["component"], "id", heavy_keys(least, "component"), "left")
    # Rows without shingles or id are linked with nothing and meet in no join.
    alone = signed.where("n = 0 OR id IS NULL").select("id", "word", "n", F.lit(None).cast("long").alias("first"))
    out = out.select("id", "word", "n", "first").unionByName(alone)
    component = F.coalesce("first", "id")
    return out.select("id", "word", "n", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that are not the first of their group; rows that share an id go by their own texts."""
    gone = saved(_groups(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))).where(~F.col("kept")).select("id", "word").distinct())
    mark, word = free_names(docs, "gone", "word_gone")
    key = _small(gone.select(F.col("id").alias(mark), F.col("word").alias(word)))
    return docs.join(key, (F.col(id_col).cast("long") == F.col(mark)) & (F.xxhash64(text_col) == F.col(word)), "left_anti")
