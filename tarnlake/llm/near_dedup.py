"""Near-duplicates by MinHash.

Every document's set of word shingles gets the minima of many universal hash functions. Documents
with equal sets form a class, and only its smallest id goes on. Classes that agree in a band of
minima share a bucket. All members of a bucket are compared with its hub (its smallest id), first
by signature, then by their full sets. Links give components by large-star and small-star.

Members that a hub doesn't link may still be linked to each other. So buckets whose other members
lie in several components are searched again, exactly: those outside the largest component are probes,
and an inverted list of the shingles gives the overlap of a probe with all members at once. A probe of
which over a fifth of the shingles are in no other set can't be linked and is passed over. Links inside
a component can't change it and aren't looked for; of several links between a probe and a component
one is returned. Nothing is capped; a bucket of many or long members is dealt out as blocks of members
and of probes.

With 32 bands of 4 minima a pair of similarity 0.8 shares no bucket once in 20 million times; an
estimate from 128 minima is more than MARGIN too low once in a million.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, drop_ids, filter_of, grouped_back, mapped, maybe_in, numbered, release, repeated_filter, resident, salt_of, settled
from .components import star_components

SHINGLE_WORDS = 5
#: Link if 100 * intersection >= PERCENT * union.
PERCENT = 80
BANDS, ROWS = 32, 4
#: A signature may understate the similarity by this much.
MARGIN = 0.18
#: Members of a bucket, and shingles of these, that one task compares with a block of probes at a time.
BLOCK, BLOCK_SHINGLES = 600, 1_000_000
#: Word hashes a worker remembers.
REMEMBERED = 200_000


def splitmix(n: int, seed: int) -> np.ndarray:
    """n well-mixed 64-bit numbers."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


FACTORS = splitmix(BANDS * ROWS, 11) | np.uint64(1)
OFFSETS = splitmix(BANDS * ROWS, 12)
BAND_FACTORS = splitmix(BANDS * ROWS, 13) | np.uint64(1)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


def shingles(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a whole text's k-word shingles; of a shorter text, of all its words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: A-Z only
    if not words:
        return np.empty(0, np.uint64)
    hashes = resident("words", None, WordHashes)
    if len(hashes) > REMEMBERED:
        hashes.clear()
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(k, len(h))
    factors = splitmix(width, 100 + width) | np.uint64(1)
    n = len(h) - width + 1
    total = h[:n] * factors[0]
    for i in range(1, width):
        total += h[i : i + n] * factors[i]
    return np.unique(mixed(total))


def signature(found: np.ndarray) -> np.ndarray:
    """The minima of the universal hash functions a * x + b over a set, as 32 bits each."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 1024):
        values = np.multiply.outer(FACTORS, found[at : at + 1024])
        values += OFFSETS[:, None]
        np.minimum(least, values.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    parts = (signatures.astype(np.uint64) + np.uint64(1)) * BAND_FACTORS
    return mixed(parts.reshape(len(signatures), BANDS, ROWS).sum(axis=2))


def sketch(df: DataFrame, text_col: str, k: int) -> DataFrame:
    """df, without the text, with n_shingles, a digest of the set and a key for each band (NULL for an empty set)."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        sets = [shingles(t, k) for t in batch.column(0).to_pylist()]
        some = [i for i, s in enumerate(sets) if len(s)]
        keys: list = [None] * len(sets)
        if some:
            for i, row in zip(some, band_keys(np.stack([signature(sets[i]) for i in some])).view(np.int64)):
                keys[i] = row
        digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        return [pa.array(map(len, sets), pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]

    return add_columns(df, run, "n_shingles bigint, digest binary, bands array<bigint>", [text_col], carry=False)


def full_sets(df: DataFrame, text_col: str, k: int) -> DataFrame:
    """df, without the text, with the signature and the whole set as bytes."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        sets = [shingles(t, k) for t in batch.column(0).to_pylist()]
        return [pa.array([signature(s).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]

    return add_columns(df, run, "sig binary, hashes binary", [text_col], carry=False)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) that are links: likely by signature, and certain by their full sets."""
    side = lambda c: sets.select(F.col("id").alias(c), F.col("sig").alias(f"sig_{c}"), F.col("hashes").alias(f"hashes_{c}"))
    # the pairs of one hub are dealt out by blocks; each block gets the hub's set
    counted = grouped_back(pairs.withColumn("salt", salt_of("u")), ["v"], "salt", [F.count("*").alias("n")], [F.sum("n").alias("n")])
    dealt = counted.select("u", "v", F.pmod(F.xxhash64("u"), F.ceil(F.col("n") / BLOCK)).cast("int").alias("block"))
    hubs = dealt.select("v", "block").distinct().join(side("v"), "v")
    rows = dealt.join(side("u"), "u").join(hubs, ["v", "block"]).select("u", "v", "sig_u", "sig_v", "hashes_u", "hashes_v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, *rest = batch.columns
            keep = []
            for su, sv, hu, hv in zip(*rest):
                su, sv = (np.frombuffer(x.as_buffer(), np.uint32) for x in (su, sv))
                if (su == sv).mean() < PERCENT / 100 - MARGIN:
                    keep.append(False)
                    continue
                a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (hu, hv))
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= PERCENT * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([u, v], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return mapped(rows, run, "u bigint, v bigint")


def _cross_links(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """For a block of a bucket's members and one of its probes: exact links between their components, at most one for a probe and a component."""
    probe = pdf["probe"].to_numpy()
    ids, comp = pdf["id"].to_numpy(), pdf["component_id"].to_numpy()
    sets = [np.frombuffer(h, np.uint64) for h in pdf["hashes"]]
    index, probes = np.flatnonzero(~probe), np.flatnonzero(probe)
    none = pd.DataFrame([], columns=["u", "v"])
    if not len(index) or not len(probes):
        return none
    sizes = np.array([len(sets[b]) for b in index])
    flat = np.concatenate([sets[b] for b in index])
    order = np.argsort(flat, kind="stable")
    flat, owners = flat[order], np.repeat(np.arange(len(index)), sizes)[order]
    out = []
    for a in probes:
        mine = sets[a]
        begin, end = (np.searchsorted(flat, mine, side=side) for side in ("left", "right"))
        often = end - begin
        if 100 * np.count_nonzero(often) < PERCENT * len(mine):  # an overlap is at least this share of either set
            continue
        places = np.repeat(begin - (np.cumsum(often) - often), often) + np.arange(often.sum())
        overlap = np.bincount(owners[places], minlength=len(index))
        linked = (100 * overlap >= PERCENT * (len(mine) + sizes - overlap)) & (comp[index] != comp[a])
        partners = index[np.flatnonzero(linked)]
        _, first = np.unique(comp[partners], return_index=True)
        out += [(max(ids[a], ids[b]), min(ids[a], ids[b])) for b in partners[first]]
    return pd.DataFrame(out, columns=["u", "v"]) if out else none


def linked_components(reps: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """id and component_id of every class with a link; reps: id, n_shingles, bands; texts: id, text of at least these."""
    keys = reps.select("id", F.col("n_shingles").alias("size"), F.explode("bands").alias("key"))
    shared = maybe_in(keys, F.col("key"), repeated_filter(keys, "key"), "__maybe").filter("__maybe").select("id", "size", "key")
    salted = shared.withColumn("__salt", salt_of("id"))
    ends = grouped_back(salted, ["key"], "__salt", [F.min("id").alias("__lo"), F.max("id").alias("__hi")], [F.min("__lo").alias("hub"), F.max("__hi").alias("last")])
    members = settled(ends.filter("hub != last").select("key", "id", "hub", "size").distinct())
    wanted = members.select(F.xxhash64("id").alias("k")).distinct()
    near = maybe_in(texts, F.xxhash64("id"), filter_of(wanted, "k"), "__maybe").filter("__maybe").select("id", "text")
    sets = settled(full_sets(near, "text", k))
    del keys, shared, salted, ends, wanted, near
    release(reps.sparkSession)
    tested = members.filter("id != hub").select(F.col("id").alias("u"), F.col("hub").alias("v")).distinct()
    found = settled(star_components(confirmed(tested, sets)))
    del tested
    release(reps.sparkSession)
    labelled = members.filter("id != hub").join(found, "id", "left").select("key", "id", "size", F.coalesce("component_id", "id").alias("component_id"), salt_of("id").alias("salt"))
    # all pairs with the hub are tested; open are buckets whose other members lie in two components
    per_salt = [F.count("*").alias("n"), F.sum("size").alias("s"), F.min("component_id").alias("a"), F.max("component_id").alias("b"), F.bit_xor(F.xxhash64("id")).alias("x"), F.min("id").alias("first")]
    per_key = [F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("a").alias("a"), F.max("b").alias("b"), F.bit_xor("x").alias("x"), F.min("first").alias("first")]
    parts = labelled.groupBy("key", "salt").agg(*per_salt)
    # of buckets with the same members, as bands of one group of near copies often have, one is searched
    keys = parts.groupBy("key").agg(*per_key).filter("a != b").groupBy("n", "s", "x", "first").agg(F.min("key").alias("key")).select("key")
    # members outside the largest component are the probes: each is held against all members once
    weights = labelled.groupBy("key", "component_id").agg(F.count("*").alias("n"), F.sum("size").alias("s")).join(keys, "key")
    largest = F.max(F.struct("n", "component_id", "s")).alias("top")
    counted = weights.groupBy("key").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), largest)
    blocks = lambda n, s: F.greatest(F.ceil(n / BLOCK), F.ceil(s / BLOCK_SHINGLES)).cast("int")
    dealing = counted.select("key", F.col("top.component_id").alias("top"), blocks(F.col("n"), F.col("s")).alias("of_members"), blocks(F.col("n") - F.col("top.n"), F.col("s") - F.col("top.s")).alias("of_probes"))
    open_ = labelled.join(parts.select("key", "salt").join(dealing, "key"), ["key", "salt"])
    own = lambda count: F.pmod(F.xxhash64("id"), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    members_ = open_.select("key", own("of_members").alias("i"), every("of_probes").alias("j"), "id", "component_id", F.lit(False).alias("probe"))
    probes = open_.filter("component_id != top").select("key", every("of_members").alias("i"), own("of_probes").alias("j"), "id", "component_id", F.lit(True).alias("probe"))
    full = members_.unionByName(probes).join(sets.select("id", "hashes"), "id").groupBy("key", "i", "j")
    links = settled(full.applyInPandas(_cross_links, "u bigint, v bigint").distinct())
    del labelled, parts, keys, weights, counted, dealing, open_, members_, probes, full
    release(reps.sparkSession)
    if links.isEmpty():
        return found
    return star_components(found.select(F.col("id").alias("u"), F.col("component_id").alias("v")).unionByName(links))


def _labelled(rows: DataFrame, words: int) -> DataFrame:
    """id, n_shingles and component_id of every row; rows: id, text."""
    sketched = settled(sketch(rows, "text", words))
    some = sketched.filter("id IS NOT NULL AND digest IS NOT NULL")
    classed = grouped_back(some.select("id", "n_shingles", "digest").withColumn("salt", salt_of("id")), ["digest"], "salt", [F.min("id").alias("least")], [F.min("least").alias("rep")])
    classed = settled(classed.select("id", "n_shingles", "rep", "salt"))
    release(rows.sparkSession)
    # the rows of representatives, found by id: a class's smallest id is one of its own
    first = some.groupBy("digest").agg(F.min("id").alias("id"))
    reps = some.select("id", "n_shingles", "digest", "bands").join(first, ["id", "digest"], "left_semi").select("id", "n_shingles", "bands")
    found = linked_components(reps, rows, words).withColumnRenamed("id", "rep")
    # a class of any size is dealt to as many tasks as it has salts
    per_salt = classed.select("rep", "salt").distinct().join(found, "rep")
    joined = classed.join(per_salt, ["rep", "salt"], "left").select("id", "n_shingles", F.coalesce("component_id", "rep").alias("component_id"))
    return joined.unionByName(sketched.filter("id IS NULL OR digest IS NULL").select("id", "n_shingles", F.col("id").alias("component_id")))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """One row per row of df: id_col, n_shingles, component_id, kept.

    A-Z are lower-cased; words are runs without ASCII white space. A text of fewer words than a
    shingle has is one shingle; one without words (or NULL) is linked with nothing. The smallest id of a
    component is kept. Rows that repeat an id count as one document, each listed. A row without an id
    is linked with nothing and kept. No row of an empty table. Other columns, of any name, are ignored.
    """
    plain, (own, text) = numbered(df, id_col, text_col)
    every = _labelled(plain.select(F.col(own).cast("bigint").alias("id"), F.col(text).cast("string").alias("text")), words)
    return every.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """The rows of df that stay, with all their columns: all but those linked to a smaller id. Rows count as in near_duplicates()."""
    plain, (own, text) = numbered(df, id_col, text_col)
    every = _labelled(plain.select(F.col(own).cast("bigint").alias("id"), F.col(text).cast("string").alias("text")), words)
    return drop_ids(df, id_col, settled(every.filter("id != component_id").select("id")))
