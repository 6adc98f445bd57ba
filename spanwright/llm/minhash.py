"""Near-duplicate documents by an inverted join over pairs of MinHash signature coordinates.

Every text is the set of its distinct word shingles. Texts with equal sets collapse into one
class first. The signature of a class has `COORDINATES` values; each two neighbouring ones are a band, and (band, values) is
a posting key: texts that have little in common rarely agree in two values at once, however many there are. A pair of
classes with at least `SHARED` equal bands and `MATCHES` equal coordinates is a candidate:

* bands that only one class holds cannot collide and are left out after counting; a class that
  keeps fewer than `SHARED` bands has no partner at all;
* of the bands left, ordered from rare to frequent, a pair with enough of them must share one of
  the first `size - SHARED + 1` (the prefix), so only these are posted; the frequent rest is
  skipped and only read through the two signatures when collisions are counted;
* similar classes form groups of up to 32 (`blocks`), and a list holds groups, not classes. Collisions are counted for
  all members of two groups at once; groups with a candidate pair are compared as bit matrices of their full sets.
  So near copies never travel pair by pair.

Long posting lists are not paired out. Each list has a few hubs, the first groups by hash orders that all
lists share, and each group is compared with its first hub in each order. Lists whose members have become
connected are closed; in the others groups are cut into parts of one component each. What open lists still hold across components is settled exactly: short lists are paired out;
the classes of long lists are posted by their full sets under the shingles by which a linked pair can first meet, from
rare to frequent, so a group of near copies meets only in what few of its members share. All these pairs must have
`MATCHES` collisions too and are confirmed on the full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwright.llm.blocks import blocks_of, grouped, members_of, opened
from spanwright.llm.words import U64, groups, mix, row_slices, shingles, utf8, word_hashes
from spanwright.session import durable, written

COORDINATES = 64
MATCHES = 33
"""A pair at similarity 0.8 has fewer equal coordinates with a probability below 1e-6."""
BANDS = COORDINATES // 2
SHARED = 6
"""A pair at similarity 0.8 has fewer equal bands with a probability below 3e-8."""
HUBS = 10
LONG = 64
"""Open lists of more parts are not paired out but settled by rare shingles; both ways are exact."""
SLOTS = 1 << 19
"""Bound of the table of hashed ids by which texts and sets are filtered before they are shuffled."""
_COLUMNS = 4096

_FACTORS = mix(np.arange(1, COORDINATES + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def signature(members: np.ndarray) -> np.ndarray:
    """COORDINATES minimum values (as signed 32-bit integers) of a non-empty set of hashes."""
    low = np.full(COORDINATES, np.iinfo(U64).max, U64)
    for at in range(0, len(members), _COLUMNS):
        low = np.minimum(low, (members[None, at:at + _COLUMNS] * _FACTORS[:, None]).min(axis=1))
    return (mix(low) >> U64(32)).astype(np.uint32).view(np.int32)


def bands(values: np.ndarray) -> np.ndarray:
    """BANDS numbers for each signature: equal where both coordinates of a band are."""
    pairs = np.ascontiguousarray(values).view(U64).reshape(-1, BANDS)
    return mix(pairs + _FACTORS[:BANDS]).view(np.int64).reshape(-1)


def packed(values: np.ndarray) -> np.ndarray:
    """The lowest byte of each coordinate, eight to a 64-bit integer: equal coordinates stay equal."""
    return (values.reshape(-1, COORDINATES) & 0xFF).astype(np.uint8).view("<i8").reshape(-1)


def _shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    data, bounds = utf8(column)
    for low, high in groups(bounds):
        rows, words = word_hashes(data[bounds[low]:bounds[high]], bounds[low:high + 1] - bounds[low])
        cuts = row_slices(rows, high - low)
        for k in range(high - low):
            yield np.unique(shingles(words[cuts[k]:cuts[k + 1]], width))


def _binary(arrays: list[np.ndarray | None]) -> pa.Array:
    return pa.array([None if a is None else a.tobytes() for a in arrays], pa.binary())


def _digest(members: np.ndarray) -> bytes:
    return hashlib.blake2b(members.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, set_id, bands, packed) per row; all but the first two are null for an empty set."""
    kind = docs.schema[id_col].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(_shingle_sets(batch.column(1), width)) if batch.num_rows else []
            flat = np.concatenate([signature(s) for s in sets if len(s)] or [np.zeros(0, np.int32)])
            filled = np.concatenate(([0], np.cumsum([len(s) > 0 for s in sets])))
            empty = pa.array([len(s) == 0 for s in sets], pa.bool_())
            keys = pa.ListArray.from_arrays(pa.array(filled * BANDS, pa.int32()), pa.array(bands(flat)))
            short = pa.ListArray.from_arrays(pa.array(filled * (COORDINATES // 8), pa.int32()), pa.array(packed(flat)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()),
                 *[pa.compute.if_else(empty, pa.scalar(None, v.type), v) for v in (keys, short)]],
                ["id", "n_shingles", "set_id", "bands", "packed"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        each, f"id {kind}, n_shingles long, set_id binary, bands array<bigint>, packed array<bigint>")


def _sifted(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose `rep` may be in `wanted`, found without a shuffle; others may stay.

    At most SLOTS numbers go to all executors. More wanted ids than that only make this filter weaker.
    """
    slot = F.pmod(F.xxhash64("rep"), F.lit(SLOTS)).cast("int").alias("slot")
    return rows.withColumn("slot", slot).join(F.broadcast(wanted.select(slot).distinct()), "slot", "left_semi").drop("slot")


def _full_sets(docs: DataFrame, wanted: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(rep, members) of the classes in `wanted` (rep, set_id), read again from the texts of their representatives."""
    kind = docs.schema[id_col].dataType.simpleString()
    texts = _sifted(docs.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text")).where("rep is not null"), wanted).join(wanted, "rep")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = batch.column(2).to_pylist()
            sets = list(_shingle_sets(batch.column(1), width)) if batch.num_rows else []
            same = [k for k, s in enumerate(sets) if _digest(s) == want[k]]  # another row may have the same id
            for at in range(0, len(same), 500):
                part = same[at:at + 500]
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate(([0], np.cumsum([len(sets[k]) for k in part]))), pa.int32()),
                    pa.array(np.concatenate([sets[k] for k in part]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(part)), lists], ["rep", "members"])

    return texts.select("rep", "text", "set_id").mapInArrow(each, f"rep {kind}, members array<bigint>")


def posting_prefixes(classes: DataFrame) -> DataFrame:
    """(token, rep, n_shingles): the bands of each signature under which its class must be posted."""
    tokens = classes.select("rep", "n_shingles", F.explode("bands").alias("token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    ordered = (tokens.join(shared, "token").groupBy("rep", "n_shingles")
               .agg(F.sort_array(F.collect_list(F.struct("held", "token"))).alias("tokens"))
               .where(F.size("tokens") >= SHARED))
    prefix = F.slice("tokens", F.lit(1), F.size("tokens") - F.lit(SHARED - 1))
    return ordered.select("rep", "n_shingles", F.explode(prefix).alias("t")).select("rep", "n_shingles", F.col("t.token").alias("token"))


def group_signatures(signed: DataFrame, placed: DataFrame) -> DataFrame:
    """(g, codes, tight) of each group: the packed signatures of its members, and whether two of them collide enough."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [np.array(x, np.int64).reshape(-1) for x in batch.column(1).to_pylist()]
            tight = [len(c) > COORDINATES // 8 and int(np.sort(collisions(c, c), axis=1)[:, -2].max()) >= MATCHES for c in codes]
            yield pa.RecordBatch.from_arrays([batch.column(0), _binary(codes), pa.array(tight, pa.bool_())], ["g", "codes", "tight"])

    held = placed.select("g", "rep").join(signed.select("rep", "packed"), "rep").groupBy("g").agg(F.collect_list("packed").alias("all"))
    return held.select("g", F.flatten("all").alias("all")).mapInArrow(each, "g bigint, codes binary, tight boolean")


def collisions(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Equal bytes of all packed signatures of two groups, at least the numbers of equal coordinates."""
    a, b = (x.view(np.uint8).reshape(-1, COORDINATES) for x in (one, two))
    return (a[:, None, :] == b[None, :, :]).sum(axis=2)


def _colliding(pairs: DataFrame, codes: DataFrame) -> DataFrame:
    """The pairs of groups (g, g2) with members that have at least MATCHES collisions."""
    for at, end in (("g", ""), ("g2", "2")):
        pairs = pairs.join(codes.select(F.col("g").alias(at), F.col("codes").alias("codes" + end)).hint("merge"), at)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = ([np.frombuffer(v.as_buffer(), np.uint8) for v in batch.column(k)] for k in (2, 3))
            keep = np.zeros(batch.num_rows, bool)
            single = np.array([len(a) == len(b) == COORDINATES for a, b in zip(one, two, strict=True)], bool)
            at = np.flatnonzero(single)
            if len(at):
                same = np.stack([one[k] for k in at]) == np.stack([two[k] for k in at])
                keep[at] = same.sum(axis=1) >= MATCHES
            for k in np.flatnonzero(~single):
                keep[k] = collisions(one[k], two[k]).max() >= MATCHES
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep)) for k in (0, 1)], ["g", "g2"])

    return pairs.select("g", "g2", "codes", "codes2").mapInArrow(each, "g bigint, g2 bigint")


def _either(pairs: DataFrame) -> DataFrame:
    return pairs.select("g").union(pairs.select("g2")).distinct()


def connect(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (rep, component) after adding the links (a, b): the smallest label reachable.

    Works on the components as nodes: each takes the smallest neighbour, then the label of that
    label, until nothing changes. Each round is written and read again. The joins are sort-merge joins by hint: the
    many small broadcasts of a loop would pile up in the driver.
    """
    named = [labels.select(F.col("rep").alias(side), F.col("component").alias("c" + side)).hint("merge") for side in ("a", "b")]
    edges = links.join(named[0], "a").join(named[1], "b").where("ca <> cb").select("ca", "cb")
    edges = written(edges.union(edges.select("cb", "ca")).distinct())
    state = edges.select(F.col("ca").alias("node"), F.col("ca").alias("low")).distinct()
    moved = 1
    while moved:
        near = (edges.join(state.select(F.col("node").alias("cb"), "low").hint("merge"), "cb")
                .groupBy(F.col("ca").alias("node")).agg(F.min("low").alias("least")))
        step = written(state.join(near.hint("merge"), "node").select("node", F.col("low").alias("was"), F.least("low", "least").alias("low")))
        up = step.select(F.col("node").alias("low"), F.col("low").alias("top")).hint("merge")
        after = written(step.join(up, "low", "left").select("node", "was", F.coalesce(F.least("top", "low"), "low").alias("low")))
        moved = after.where("was <> low").count()
        state = after.select("node", "low")
    moves = state.where("node <> low").select(F.col("node").alias("component"), "low").hint("merge")
    return written(labels.join(moves, "component", "left").select("rep", F.coalesce("low", "component").alias("component")))


def _fit(one: tuple[Column, Column], two: tuple[Column, Column], percent: int) -> Column:
    """Least and greatest sizes of two groups that leave room for a link."""
    return (one[1] * 100 >= two[0] * percent) & (two[1] * 100 >= one[0] * percent)


def _hub_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (g, g2) of each group with its first possible hub in each of HUBS hash orders, over its lists."""
    orders = range(HUBS)
    hubs = lists.groupBy("token").agg(F.count(F.lit(1)).alias("held"), *[
        F.min(F.struct(F.hash("g", F.lit(k)).alias("h"), "g", "lo", "hi")).alias(f"hub{k}") for k in orders]).where("held > 1").drop("held")
    first = lists.join(hubs, "token").groupBy("g").agg(*[
        F.min(F.when(_possible_hub(F.col(f"hub{k}"), percent), F.col(f"hub{k}"))).alias(f"hub{k}") for k in orders])
    found = first.select("g", F.explode(F.array_distinct(F.array_compact(F.array(*[F.col(f"hub{k}.g") for k in orders])))).alias("g2"))
    return found.select(F.least("g", "g2").alias("g"), F.greatest("g", "g2").alias("g2")).distinct()


def _possible_hub(hub: Column, percent: int) -> Column:
    """Another group, not ruled out by the sizes alone."""
    return (F.col("g") != hub["g"]) & _fit((F.col("lo"), F.col("hi")), (hub["lo"], hub["hi"]), percent)


def split_groups(placed: DataFrame, labels: DataFrame) -> DataFrame:
    """(rep, set_id, c, p, component, g, members): the groups p cut into parts g of one component each."""
    part = Window.partitionBy("p", "component")
    at = placed.select("rep", "set_id", "c", F.col("g").alias("p")).join(labels.dropDuplicates(["rep"]), "rep")
    return at.withColumn("g", F.min("c").over(part)).withColumn("members", F.count(F.lit(1)).over(part))


def _open_lists(postings: DataFrame, parts: DataFrame) -> DataFrame:
    """(token, g, lo, hi, p, members, component, long) of the lists whose members are not all in one component."""
    at = postings.join(parts, "rep").groupBy("token", "g").agg(
        F.min("n_shingles").alias("lo"), F.max("n_shingles").alias("hi"), *[F.first(c).alias(c) for c in ("p", "members", "component")])
    found = (at.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("held"))
             .where("low < high").select("token", (F.col("held") > LONG).alias("long")))
    return at.join(found, "token")


def _apart(percent: int) -> Column:
    """Parts of two groups and of two components that could hold a link, the one with fewer members first."""
    first = (F.col("members") < F.col("members2")) | ((F.col("members") == F.col("members2")) & (F.col("g") < F.col("g2")))
    near = _fit((F.col("lo"), F.col("hi")), (F.col("lo2"), F.col("hi2")), percent)
    return (F.col("component") != F.col("component2")) & (F.col("p") != F.col("p2")) & first & near


_PAIR = ("g", "g2", "p", "p2")


def _short_pairs(here: DataFrame, percent: int) -> DataFrame:
    """All candidate pairs (g, g2, p, p2) across components in lists of at most LONG parts."""
    other = here.select("token", *[F.col(c).alias(c + "2") for c in ("g", "lo", "hi", "p", "members", "component")])
    return here.join(other, "token").where(_apart(percent)).select(*_PAIR).distinct()


def set_prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(shingle, rep, size, left, later) of the shingles by which a class can have its first shingle in common with another.

    Shingles of one class only are left out; the others are ordered from rare to frequent. `left` is how many of them are
    not before this one: no pair whose first common shingle it is has more in common. `later` says that this can
    be enough for a partner of the same size or larger, not only for a smaller one.
    """
    flat = sets.select("rep", F.size("members").alias("size"), F.explode("members").alias("shingle"))
    shared = flat.groupBy("shingle").agg(F.count(F.lit(1)).cast("int").alias("held")).where("held > 1")
    ordered = (flat.join(shared, "shingle").groupBy("rep", "size")
               .agg(F.sort_array(F.collect_list(F.struct("held", "shingle"))).alias("found"))
               .where(F.size("found") * 100 >= F.col("size") * percent))
    spent = F.floor((F.col("size") * percent + 99) / 100).cast("int")
    placed = ordered.select("rep", "size", F.size("found").alias("k"), F.posexplode(
        F.slice("found", F.lit(1), F.size("found") - spent + 1)).alias("at", "f"))
    left = F.col("k") - F.col("at")
    return placed.select(F.col("f.shingle").alias("shingle"), "rep", "size", left.alias("left"),
                         (left * (100 + percent) >= F.col("size") * (2 * percent)).alias("later"))


def _long_pairs(prefixes: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Pairs (g, g2, p, p2) across components with members whose first common shingle can leave room for a link."""
    at = prefixes.join(parts.hint("merge"), "rep").groupBy("shingle", "g").agg(
        F.min("size").alias("lo"), F.max("size").alias("hi"), F.max("left").alias("left"), F.max("later").alias("later"),
        *[F.first(c).alias(c) for c in ("p", "members", "component")])
    lists = at.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("shingle")
    here = durable(at.join(lists, "shingle"))
    other = here.select(*[F.col(c).alias(c + "2") for c in here.columns])
    room = (F.col("later") | F.col("later2")) & (F.least("left", "left2") * (100 + percent) >= (F.col("lo") + F.col("lo2")) * percent)
    return here.hint("merge").join(other, (F.col("shingle") == F.col("shingle2")) & _apart(percent) & room).select(*_PAIR).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for every row of `docs`.

    Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; a text of fewer than `width` words is one
    shingle. Rows are linked when 100 * intersection >= percent * union of their shingle sets.
    component_id is the smallest id reachable over links; kept says whether that is the row's own.

    A null or empty text has no shingles and is linked with nothing. A row with a null id takes no
    part in links and is kept, with a null component. Repeated rows with one id are equal members
    of the component (all are kept, or none). Other columns are ignored. An empty table gives an
    empty result.
    """
    rows = durable(signatures(docs, width, id_col, text_col))
    usable = F.col("id").isNotNull() & F.col("set_id").isNotNull()
    classes = durable(rows.where(usable).groupBy("set_id").agg(F.min("id").alias("rep"), F.first("n_shingles").cast("int").alias("n_shingles"),
                                                                F.first("bands").alias("bands"), F.first("packed").alias("packed")))
    # Two rows may share an id but not a text: their classes then have one representative and one set of links.
    postings = durable(posting_prefixes(classes))
    active = postings.select("rep").distinct()
    signed = durable(classes.join(active, "rep").select("rep", "set_id", "packed", F.col("n_shingles").cast("long").alias("n"),
                                                        F.get("bands", F.lit(0)).alias("m1"), F.get("bands", F.lit(1)).alias("m2")))
    placed = durable(grouped(signed.withColumn("c", F.monotonically_increasing_id())))
    labels = signed.select("rep", F.col("rep").alias("component"))

    codes = durable(group_signatures(signed, placed))
    lists = durable(postings.join(placed.select("rep", "g").hint("merge"), "rep").groupBy("token", "g").agg(
        F.min("n_shingles").alias("lo"), F.max("n_shingles").alias("hi")))

    def built(wanted: DataFrame, members: DataFrame) -> DataFrame:
        members = members.join(wanted, "g").select("rep", "set_id", "g", "c")
        return durable(blocks_of(members_of(docs, members, width, id_col, text_col), percent))

    def named(links: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            links = links.join(placed.select(F.col("c").alias(side), F.col("rep").alias("r" + side)), side)
        return links.select(F.col("ra").alias("a"), F.col("rb").alias("b"))

    met = durable(_colliding(_hub_pairs(lists, percent), codes))
    blocks = built(_either(met).union(codes.where("tight").select("g")).distinct(), placed)
    labels = connect(labels, named(blocks.select(F.inline("links")).union(opened(met, blocks, percent))))
    parts = durable(split_groups(placed, labels))
    still = durable(_open_lists(postings, parts))
    crowd = parts.join(still.where("long").select("g").distinct(), "g").select("rep", "set_id")
    sets = durable(_full_sets(docs, crowd, width, id_col, text_col))
    apart = _short_pairs(still.where("not long"), percent).union(_long_pairs(set_prefixes(sets, percent), parts, percent))
    tried = met.select(F.col("g").alias("low"), F.col("g2").alias("high"))
    apart = (apart.distinct().withColumn("low", F.least("p", "p2")).withColumn("high", F.greatest("p", "p2"))
             .join(tried, ["low", "high"], "left_anti").select("g", "g2"))
    later = durable(_colliding(apart, group_signatures(signed, parts)))
    labels = connect(labels, named(opened(later, built(_either(later), parts), percent)))
    known = classes.select("set_id", "rep").join(labels.where("rep <> component"), "rep", "left")
    component = F.when(F.col("set_id").isNull() | F.col("id").isNull(), F.col("id")).otherwise(F.coalesce("component", "rep"))
    return (rows.select("id", "n_shingles", "set_id").join(known, "set_id", "left")
            .select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"))
            .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))))
