"""MinHash near-duplicate detection with tensored banding and exact confirmation.

1. Every text becomes a set of hashed word shingles; 2 collections of TABLES short bands of ROWS minhashes are
   taken from it. The key of table (i, j) joins band i of the first collection with band j of the second, so
   2 * TABLES * ROWS minhashes give TABLES**2 tables of 2 * ROWS rows each. At a similarity of 0.85 a pair
   shares no key with probability 5e-7, at 0.8 with 2e-5. Keys are never stored: two documents share one exactly
   if they share a band of each collection, and bands are 2 * TABLES rows a document where keys were TABLES**2.
2. Documents with equal sets form a class and only its smallest id goes on. A class whose bands are all alone
   in one of the collections can share no key and goes no further.
3. Each band proposes its smallest id as centre. A document is held, on full sets, against two centres at
   most of those that it shares a key with, the one of most bands and the smallest: a number of pairs linear in
   the documents, which already merges most of a large group.
4. What is left is searched completely. A band is open if its members aren't all merged, and a document if it has an
   open band in each collection. Of an open document's shingles, from rare to frequent, the first (100 - percent) % are its
   prefix: with any similar document it shares one, at a place in both that allows their sizes. A shingle is live if such
   places of documents not yet merged meet in it; those without live shingles have no more links. The others are dealt
   into tiles of at most TILE_BYTES by the hottest live shingle that they or those they meet have, a large merged group
   apart from the rest, and each goes to the tile pairs in which it meets another by a live shingle, unless both tiles are
   of one merged group. A pair is one task's group, in which all that share a key, aren't merged yet and can reach the
   similarity by size and signature are confirmed on full sets. A hot group spreads over many tile pairs; none is ever
   collected whole and no pairs of documents are written out. The rows of tile pairs are one a document while a cluster
   fits a tile; beyond that they grow with its live documents times its tiles.
5. The links' components are found by min-label steps with pointer jumping, stored each step.

Each intermediate table is deleted once its successors exist.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import Memo, discard, prepare, settle, settle_driver, stored

ROWS, TABLES = 3, 16
#: Bounds of a tile: bytes of sets and sketches, and documents; a document takes so many bytes beside its set.
TILE_BYTES, TILE_DOCS, SKETCH_BYTES = 4 << 20, 4096, 400
#: Buckets, a power of two, in which shingles are counted to order them by rarity; any order finds the same links.
RARITY = 1 << 20
#: Broadcast up to so many ids, and sketches of some 250 bytes.
BROADCAST_IDS, BROADCAST_SKETCHES = 500_000, 100_000
#: Signature agreement, of 2 * ROWS * TABLES minhashes, under which a pair at the similarity is too unlikely (5 deviations).
SLACK = 5.0
_RNG = np.random.default_rng(20)
_FACTORS = _RNG.integers(0, 2**63, 2 * ROWS * TABLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _RNG.integers(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORDS = Memo(xxhash.xxh3_64_intdigest, 100_000, 64)


def shingles(text: str | None, words_each: int = 3) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; ASCII letters lower-cased, words cut at ASCII white space.

    A text with fewer words is one shingle, of the whole sequence; one without words has none.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = min(words_each, len(ids))
    size = len(ids) - n + 1
    h = np.full(size, n, np.uint64)
    for k in range(n):
        h = (h ^ ids[k : k + size]) * _MIX[k % 16]
        h ^= h >> np.uint64(29)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return np.unique(h ^ (h >> np.uint64(32)))


def minhashes(found: np.ndarray) -> np.ndarray:
    """The minimum of the set under each multiplicative hash; long sets in blocks."""
    out = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 8192):
        out = np.minimum(out, np.multiply.outer(_FACTORS, found[at : at + 8192]).min(1))
    return out


def bands(mins: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each short band, different bands apart."""
    grouped = mins.reshape(2 * TABLES, ROWS)
    h = np.arange(1, 2 * TABLES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(ROWS):
        h = (h ^ grouped[:, k]) * _MIX[8 + k]
        h ^= h >> np.uint64(31)
    return h


def digest_of(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def sketch(docs: DataFrame, words_each: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, digest of the set, band hashes, one byte of each minhash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, band, sign = [], [], [], []
            for t in batch.column(1):
                found = shingles(t.as_py(), words_each)
                mins = minhashes(found)
                n.append(len(found))
                digest.append(digest_of(found))
                band.append(bands(mins).view(np.int64) if len(found) else np.zeros(0, np.int64))
                sign.append((mins >> np.uint64(40)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(band, pa.list_(pa.int64())), pa.array(sign, pa.binary())], ["doc_id", "n_shingles", "digest", "bands", "signature"]
            )
        _WORDS.clear()
        settle()

    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands array<long>, signature binary")


def components(edges: DataFrame) -> DataFrame:
    """id, label: the smallest id that each end of the undirected edges (x, y) reaches. The result is a stored table."""
    both = stored(edges.select("x", "y").union(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    labels = stored(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("id"), F.least("x", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("y"), F.col("label").alias("l")), "y").groupBy("x").agg(F.min("l").alias("l"))
        step = stored(labels.join(near, labels.id == near.x).select("id", F.col("label").alias("old"), F.least("label", "l").alias("label")), "step")
        # only labels that have moved on themselves are looked up
        heads = step.filter("label < id").select(F.col("id").alias("at"), F.col("label").alias("next"))
        jump = step.select(F.col("label").alias("at")).distinct().join(heads, "at")
        moved = stored(step.join(jump, step.label == jump.at, "left").select("id", "old", F.coalesce("next", "label").alias("label")), "labels")
        discard(labels, step)
        labels = moved
        settle_driver(edges.sparkSession)
        if moved.filter("old <> label").isEmpty():
            discard(both)
            return labels


def _confirm(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _star_links(sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) of a set and one of its centres whose full sets are similar."""
    left = sets.select(F.col("id").alias("x"), F.col("set").alias("set_x"), F.explode("centres").alias("c"))
    wanted = sets.select(F.explode("centres").alias("c")).distinct()
    right = sets.select(F.col("id").alias("c"), F.col("set").alias("set_c")).join(wanted, "c", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_confirm(np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64), percent) for a, b in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return left.join(right, "c").select("x", F.col("c").alias("y"), "set_x", "set_c").mapInArrow(run, "x long, y long")


def _tile_links(ids: np.ndarray, labels: np.ndarray, n: np.ndarray, band: np.ndarray, sign: np.ndarray, tile: np.ndarray, whole: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that merge labels, confirmed on full sets, between the documents of two tiles or within one."""
    _, dense = np.unique(np.concatenate(whole), return_inverse=True)
    dense = np.split(dense, np.cumsum([len(s) for s in whole])[:-1])
    flag = np.zeros(max((int(d.max()) for d in dense if len(d)), default=0) + 1, bool)
    p = percent / 100
    least = p - SLACK * np.sqrt(p * (1 - p) / sign.shape[1])
    parent = {v: v for v in labels.tolist()}

    def root(v):
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    out, one_tile = [], bool((tile == tile[0]).all())
    for k in range(len(ids) - 1):
        rest = slice(k + 1, None)
        ok = (labels[rest] != labels[k]) & (100 * np.minimum(n[rest], n[k]) >= percent * np.maximum(n[rest], n[k]))
        if not one_tile:
            ok &= tile[rest] != tile[k]
        others = np.nonzero(ok)[0] + k + 1
        if not len(others):
            continue
        same = (band[others] == band[k]) & (band[k] != 0)  # 0: a band that is alone
        others = others[same[:, :TABLES].any(1) & same[:, TABLES:].any(1)]
        others = others[(sign[others] == sign[k]).mean(1) >= least]
        if not len(others):
            continue
        flag[dense[k]] = True
        for j in others.tolist():
            a, b = root(labels[k]), root(labels[j])
            if a != b:
                both = int(np.count_nonzero(flag[dense[j]]))
                if 100 * both >= percent * (n[k] + n[j] - both):
                    parent[max(a, b)] = min(a, b)
                    out.append((int(ids[k]), int(ids[j])))
        flag[dense[k]] = False
    return out


def _search_tiles(percent: int):
    """A function over rows sorted by tile pair; one pair's rows are held at a time."""

    def links(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).sort_by("id")
        wide = lambda name, kind: np.array([np.frombuffer(x, kind) for x in t[name].to_pylist()])
        ids, n, sign = t["id"].to_numpy(), t["n_shingles"].to_numpy(), wide("signature", np.uint8)
        # repeated rows of one id and text stand beside each other or count twice, which finds the same links
        found = _tile_links(ids, t["label"].to_numpy(), n, np.array(t["bands"].to_pylist(), np.int64), sign, t["tile"].to_numpy(), [np.frombuffer(x, np.uint64) for x in t["set"].to_pylist()], percent)
        return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            pair = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1)
            cuts = [0, *(np.nonzero((pair[1:] != pair[:-1]).any(1))[0] + 1).tolist(), len(pair)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if at != tuple(pair[a]) and held:
                    yield links(held)
                    held = []
                at = tuple(pair[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield links(held)
        held = None
        settle()

    return run


def _shared_bands(rows: DataFrame, first: int) -> DataFrame:
    """id, digest and own: band, hash and smallest id of each of TABLES bands, from `first` on, that another id has too; rows without any are left out."""
    spread = rows.select("id", "digest", F.posexplode(F.slice("bands", first + 1, TABLES)).alias("band", "hash"))
    shared = stored(spread.groupBy("hash").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low <> high").select("hash", "low"), "shared")
    own = spread.join(shared, "hash").select("id", "digest", F.struct((F.col("band") + first).alias("band"), "hash", "low").alias("b"))
    got = stored(own.groupBy("id", "digest").agg(F.collect_set("b").alias(f"own_{first}")), "own")  # TABLES values at most
    discard(shared)
    return got


def _rarity(sets: DataFrame) -> np.ndarray:
    """How many shingles of all sets fall into each of RARITY buckets of hashes: orders shingles from rare to frequent, whatever collides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(RARITY, np.int64)
        for batch in batches:
            counts += np.bincount(_buckets(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64)), minlength=RARITY)
        at = np.nonzero(counts)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], ["bucket", "n"])
        settle()

    got = sets.select("set").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(RARITY, np.uint32)
    out[got["bucket"].to_numpy()] = np.minimum(got["n"].to_numpy(), 2**32 - 1)
    return out


def _buckets(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(64 - RARITY.bit_length() + 1)).astype(np.int64)


def prefix(found: np.ndarray, rarity: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The set's rarest shingles of which one must be the first that it shares with a similar set, and of each the largest such set.

    If the i-th (from 0) of n is the first shared, n - i at most are; so 100 * both >= percent * either bounds the other's size.
    """
    n = len(found)
    size = n - -(-percent * n // 100) + 1
    first = found[np.lexsort((found, rarity[_buckets(found)]))[:size]]
    return first, (n - np.arange(size)) * (100 + percent) // percent - n


def _prefixes(rarity: np.ndarray, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [prefix(np.frombuffer(x.as_py(), np.uint64), rarity, percent) for x in batch.column(2)]
            lists = [pa.array([g[0].view(np.int64) for g in got], pa.list_(pa.int64())), pa.array([g[1] for g in got], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *lists], ["id", "digest", "token", "reach"])
        settle()

    return run


def _open_tiles(active: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """t1, t2, tile and all that the search needs of each document that can have a link across the tile pair; and stored tables behind it."""
    hashes = F.concat(F.transform("own_0", lambda b: F.struct(b["band"], b["hash"])), F.transform(f"own_{TABLES}", lambda b: F.struct(b["band"], b["hash"])))
    named = active.join(labels.select("id", "label"), "id", "left").select("id", "digest", "n_shingles", F.coalesce("label", "id").alias("label"), hashes.alias("hashes"))
    spread = named.select("id", "digest", "label", "n_shingles", F.inline("hashes"))
    mixed = stored(spread.groupBy("hash").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a <> b").select("hash"), "mixed")
    own = spread.join(mixed, "hash").groupBy("id", "digest").agg(
        F.first("label").alias("label"),
        F.first("n_shingles").alias("n_shingles"),
        (F.max(F.col("band") < TABLES) & F.max(F.col("band") >= TABLES)).alias("both"),
        F.map_from_entries(F.collect_set(F.struct("band", "hash"))).alias("of"),  # 2 * TABLES values at most
    )
    bands = F.transform(F.sequence(F.lit(0), F.lit(2 * TABLES - 1)), lambda k: F.coalesce(F.element_at("of", k), F.lit(0).cast("long"))).alias("bands")
    left = stored(own.filter("both").select("id", "digest", "label", "n_shingles", bands), "open")
    discard(mixed)

    # similar sets share a shingle of both prefixes, at places that allow each other's size
    firsts = sets.select("id", "digest", "set").mapInArrow(_prefixes(_rarity(sets), percent), "id long, digest binary, token array<long>, reach array<long>")
    firsts = firsts.join(left.select("id", "digest", "label", "n_shingles"), ["id", "digest"])
    at = stored(firsts.select("id", "digest", "label", "n_shingles", F.inline(F.arrays_zip("token", "reach"))), "prefixes")
    several = [F.min("label").alias("a"), F.max("label").alias("b")]
    met = at.groupBy("token").agg(*several, F.min("n_shingles").alias("low")).filter("a <> b").select("token", "low")
    near = stored(at.join(met, "token").filter("low <= reach").drop("low", "reach"), "near")
    heat = near.groupBy("token").agg(*several, F.count(F.lit(1)).alias("n")).filter("a <> b").select("token", "n")
    live = stored(near.join(heat, "token"), "live")
    discard(at, near)

    # a document's cluster is the hottest shingle that it or one that it meets has: what meets a hot group shares tiles
    top = live.groupBy("id", "digest").agg(F.max(F.struct("n", "token")).alias("top"))
    best = live.join(top, ["id", "digest"]).groupBy("token").agg(F.max("top").alias("best"))
    weight = (F.first("n_shingles") * 8 + SKETCH_BYTES).alias("bytes")
    homes = stored(live.join(best, "token").groupBy("id", "digest").agg(F.first("label").alias("label"), weight, F.max("best")["token"].alias("cluster")), "homes")
    # a merged group of a quarter of a tile or more has tiles of its own; the rest of a cluster shares tiles
    parts = F.greatest(F.ceil(F.sum("bytes") / TILE_BYTES), F.ceil(F.count(F.lit(1)) / TILE_DOCS)).alias("parts")
    large = (F.sum("bytes") >= TILE_BYTES / 4) | (F.count(F.lit(1)) >= TILE_DOCS / 4)
    groups = homes.groupBy("cluster", "label").agg(parts, large.alias("large"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
    groups = stored(groups, "groups")
    rest = groups.filter("not large").groupBy("cluster").agg(F.greatest(F.ceil(F.sum("bytes") / TILE_BYTES), F.ceil(F.sum("n") / TILE_DOCS)).alias("shares"))
    dealt = homes.drop("bytes").join(groups.filter("large").select("cluster", "label", "parts"), ["cluster", "label"], "left").join(rest, "cluster", "left")
    pure = F.when(F.col("parts").isNotNull(), F.col("label"))
    tile = F.xxhash64("cluster", F.coalesce(pure, F.lit(-1)), F.pmod(F.xxhash64("id"), F.coalesce("parts", "shares")))
    tiled = stored(dealt.select("id", "digest", tile.alias("tile"), pure.alias("pure")), "tiled")
    discard(homes, groups)

    # a document goes to the tiles that have one of its live shingles, not to all that meet its tile
    meet = live.select("id", "digest", "token").join(tiled, ["id", "digest"]).groupBy("token").agg(F.collect_set(F.struct("tile", "pure")).alias("tiles"))
    reached = live.join(meet, "token").groupBy("id", "digest").agg(F.array_distinct(F.flatten(F.collect_set("tiles"))).alias("tiles"))
    apart = lambda t: F.when(t["tile"] == F.col("tile"), t["pure"].isNull()).otherwise(~F.coalesce(t["pure"] == F.col("pure"), F.lit(False)))
    pair = lambda t: F.struct(F.least("tile", t["tile"]).alias("t1"), F.greatest("tile", t["tile"]).alias("t2"))
    asked = stored(tiled.join(reached, ["id", "digest"]).select("id", "digest", "tile", F.transform(F.filter("tiles", apart), pair).alias("pairs")), "asked")
    discard(live, tiled)
    members = asked.join(left.select("id", "digest", "label", "bands"), ["id", "digest"]).join(sets.select("id", "digest", "n_shingles", "signature", "set"), ["id", "digest"])
    rows = members.select(F.inline("pairs"), "tile", "id", "label", "n_shingles", "bands", "signature", "set")
    return rows.repartition("t1", "t2").sortWithinPartitions("t1", "t2"), [left, asked]


def link_components(docs: DataFrame, percent: int = 85, words_each: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest id reached over links, itself included), kept.

    Two documents are linked if 100 * |both| >= percent * |either| for their shingle sets. Null and empty texts
    and texts without words have no shingles and no links. Rows that repeat an id are one document: all its texts'
    links count for it and all its rows have one component. A row with a null id isn't linked: its component is null
    and it is kept. Other columns are ignored; an empty table gives an empty table.
    """
    prepare(docs.sparkSession)
    sketches = stored(sketch(docs, words_each, id_col, text_col), "sketches")
    rows = sketches.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = stored(rows.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "classes")
    firsts = rows.join(classes, (rows.digest == classes.digest) & (rows.doc_id == classes.rep), "left_semi")
    firsts = stored(firsts.select(F.col("doc_id").alias("id"), "digest", "n_shingles", "bands", "signature"), "firsts")

    # bands that no other class has can't be part of a shared key
    one = _shared_bands(firsts, 0)
    halfway = firsts.join(one.select("id", "digest"), ["id", "digest"], "left_semi")
    two = _shared_bands(halfway, TABLES)
    lows = [F.transform(c, lambda b: b["low"]) for c in ("own_0", f"own_{TABLES}")]
    shared = F.filter(F.array_intersect(*lows), lambda c: c != F.col("id"))
    voted = F.transform("shared", lambda c: F.struct(F.size(F.filter("lows", lambda v: v == c)).alias("v"), (-c).alias("c")))
    both = one.join(two, ["id", "digest"]).withColumns({"shared": shared, "lows": F.concat(*lows)})
    centres = F.when(F.size("shared") > 0, F.array_distinct(F.array(-F.array_max(voted)["c"], F.array_min("shared")))).otherwise(F.array().cast("array<long>"))
    own = stored(both.select("id", "digest", "own_0", f"own_{TABLES}", centres.alias("centres")), "active")
    discard(one, two)
    active = firsts.select("id", "digest", "n_shingles", "signature").join(own, ["id", "digest"])

    few = active.select("id", F.col("digest").alias("d"), "n_shingles", "signature", "centres")
    n_active = few.count()
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    wanted = texts.join(F.broadcast(few) if n_active <= BROADCAST_SKETCHES else few, "id").select("id", "d", "n_shingles", "signature", "centres", "text")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py(), words_each) for t in batch.column(5)]
            own = pa.array([digest_of(f) == d.as_py() for f, d in zip(found, batch.column(1), strict=True)], pa.bool_())
            columns = [*batch.columns[:5], pa.array([f.tobytes() for f in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "digest", "n_shingles", "signature", "centres", "set"]).filter(own)
        _WORDS.clear()
        settle()

    settle_driver(docs.sparkSession)
    sets = stored(wanted.mapInArrow(full, "id long, digest binary, n_shingles long, signature binary, centres array<long>, set binary"), "sets")
    links = stored(_star_links(sets, percent).union(_repeated_ids(rows, classes)), "links")
    labels = components(links)
    search, behind = _open_tiles(active, labels, sets, percent)
    found = stored(search.mapInArrow(_search_tiles(percent), "x long, y long"), "links")
    discard(sets, firsts, own, labels, *behind)
    labels = components(links.union(found))
    discard(links, found)
    settle_driver(docs.sparkSession)

    # classes of one row without links need no lookup
    moved = classes.join(labels.select(F.col("id").alias("rep"), "label"), "rep", "left").select("digest", F.coalesce("label", "rep").alias("component"), "n", "rep")
    moved = stored(moved.filter("n > 1 or component < rep").select("digest", "component"), "moved")
    out = sketches.select("doc_id", "n_shingles", "digest").join(F.broadcast(moved) if moved.count() <= BROADCAST_IDS else moved, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component")), "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    again = _ids_with_several_sets(sketches.filter(F.col("doc_id").isNotNull()))
    if not again.isEmpty():
        of_id = stored(out.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("c")), "repeated")
        out = out.join(of_id, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("c", "component_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _ids_with_several_sets(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).filter("a <> b").select("doc_id")


def _repeated_ids(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of the texts that one id has."""
    several = rows.join(_ids_with_several_sets(rows), "doc_id", "left_semi").select("doc_id", "digest")
    reps = several.join(classes, "digest").groupBy("doc_id").agg(F.collect_set("rep").alias("reps"))  # the texts of one id
    return reps.select(F.explode("reps").alias("x"), F.array_min("reps").alias("y")).filter("x <> y")


def keep_one_each(docs: DataFrame, percent: int = 85, words_each: int = 3) -> DataFrame:
    """The input's rows and columns without those whose component has a smaller id; rows that repeat a kept id stay.

    Removed ids are joined back by a broadcast only while they are few; else both sides are dealt by id.
    """
    gone = stored(link_components(docs, percent, words_each).filter(~F.col("kept")).select("doc_id").distinct(), "gone")
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, docs["doc_id"] == gone["doc_id"], "left_anti")


def oracle_sql(percent: int = 85) -> str:
    """DuckDB SQL for link_components over documents."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') ws from documents),
s as (select distinct doc_id, sh from (select doc_id, unnest(case when len(ws) = 0 then []::varchar[] when len(ws) < 3 then [array_to_string(ws, ' ')]
  else list_transform(range(1, len(ws) - 1), lambda k: ws[k] || ' ' || ws[k + 1] || ' ' || ws[k + 2]) end) sh from w)),
n as (select doc_id, count(*) n from s group by doc_id),
p as (select a.doc_id x, b.doc_id y, count(*) c from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id group by 1, 2),
e as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= {percent} * (nx.n + ny.n - c)),
r(x, y) as (select doc_id, doc_id from documents union select r.x, e.y from r join e on e.x = r.y)
select d.doc_id, coalesce(n.n, 0)::bigint n_shingles, m.c component_id, d.doc_id = m.c kept
from documents d left join n using (doc_id) join (select x, min(y) c from r group by x) m on m.x = d.doc_id"""
