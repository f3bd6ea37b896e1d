"""Removal of long passages that an earlier document has too, by suffix sorting.

A passage of SPAN bytes that also starts in a document with a smaller id is removed. To bring equal
passages together without shuffling every suffix, each passage is given an anchor: the least hash
of its GRAM-byte strings, which its content alone decides. Anchors met in one content only are done
with. For the others, runs of passages with one anchor are cut by context (the anchor with as many bytes
on one side as all of the run's passages have there) and go, as fragments, to the bucket of the context:
a short line met everywhere is one anchor, but has as many contexts as neighbours.
A bucket sorts the suffixes of all its different fragments by the column-wise construction of their
Burrows-Wheeler transform with common prefixes (bwt.py): neighbours that share SPAN bytes are equal
passages, and the smallest id of each group decides. Where one context has too many fragments to be
sorted together, equal passages are told by their distance from the anchor and their bytes.

Later copies of a whole content cost little: a digest tells them, and they go no further, as the first copy has
all their passages. A row is known by its id, and by a hash of its content (`content`) only where
the id is repeated: such a hash beside every record would be a large part of what shuffles. Hot anchors and fragments are
combined before anything shuffles. Buckets come sorted, one at a time; the sequences of the
construction are those of one bucket, and Spark's shuffle files are its external files. Nothing is
capped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bwt import collection_bwt
from .common import add_columns, filter_of, grouped_back, mapped, maybe_in, numbered, release, renamed, repeated_filter, salt_of, settled, slices, text_of
from .near_dedup import mixed

#: Bytes of a passage, of an anchor, and anchors in a passage.
SPAN, GRAM = 50, 16
WIDTH = SPAN - GRAM + 1
SIDE = (SPAN - GRAM + 1) // 2
#: Bytes and documents whose anchors a task sends on together, bytes hashed at once, and bytes of fragments sent on together.
CHUNK_BYTES, CHUNK_DOCS, HASHED_BYTES, FRAGMENT_BYTES = 4_000_000, 2000, 400_000, 8_000_000
#: Bytes of text for each bucket, which bounds what a task holds of one, and buckets for each shuffle partition at least.
BUCKET_BYTES, BUCKETS_PER_PARTITION = 8_000_000, 2
#: Low bits of a hash of an anchor or a context that choose its bucket; the others tell those of a bucket apart.
BUCKET_BITS = 24
#: Fragments looked at together, unless one context has more, and of these sorted together.
LOOK, COLLECTION = 20_000, 8_000
BUCKET_MASK = np.uint64((1 << BUCKET_BITS) - 1)
SHIFT = bytes([*range(1, 256), 255])

#: Records that travel between tasks.
CAND = np.dtype([("id", "<i8"), ("content", "<i8"), ("hash", "<u8"), ("start", "<u4"), ("n", "u1"), ("at", "u1")])
COVER = np.dtype([("id", "<i8"), ("content", "<i8"), ("start", "<u4"), ("n", "u1")])
ANCHOR = np.dtype([("high", "<u4"), ("low", "u1"), ("start", "<u4"), ("doc", "<u2"), ("n", "u1"), ("at", "u1")])
#: A candidate as it travels, without a hash: that of a fragment follows from the bytes sent beside it.
SENT = np.dtype([("id", "<i8"), ("content", "<i8"), ("start", "<u4"), ("n", "u1"), ("at", "u1")])
DOC = np.dtype([("id", "<i8"), ("content", "<i8")])


def packed(records: np.ndarray) -> bytes:
    """Records as compressed bytes, field by field and byte by byte: most of these repeat from record to record."""
    fields = [np.ascontiguousarray(records[name]).view(np.uint8).reshape(len(records), -1).T.tobytes() for name in records.dtype.names]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(fields))


def unpacked(data: bytes, kind: np.dtype) -> np.ndarray:
    raw = zstandard.decompress(data)
    records, at = np.zeros(len(raw) // kind.itemsize, kind), 0
    for name in kind.names:
        width = kind[name].itemsize
        part = np.frombuffer(raw, np.uint8, len(records) * width, at).reshape(width, len(records))
        records[name] = np.ascontiguousarray(part.T).view(kind[name]).ravel()
        at += len(records) * width
    return records


def gram_hashes(buffer: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place."""
    n = len(buffer) - GRAM + 1
    padded = np.concatenate([buffer, np.zeros(24, np.uint8)])
    eight = np.empty(len(buffer) + 8, np.uint64)  # the eight bytes from each place
    for o in range(8):
        into = eight[o::8]
        into[:] = np.frombuffer(padded.data, "<u8", count=len(into), offset=o)
    h = eight[:n] * np.uint64(0x9E3779B97F4A7C15)
    h += eight[8 : 8 + n] * np.uint64(0xC2B2AE3D27D4EB4F)
    return mixed(h)


Runs = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def anchor_runs(texts: list[bytes]) -> Runs:
    """Text, first passage, number of passages, hash and place in the first passage of each run with one anchor."""
    parts, begin, size = [], 0, 0
    for end, text in enumerate(texts, 1):
        size += len(text)
        if size >= HASHED_BYTES or end == len(texts):
            owner, *rest = _anchor_runs(texts[begin:end])
            parts.append((owner + begin, *rest))
            begin, size = end, 0
    return tuple(map(np.concatenate, zip(*parts))) if parts else _anchor_runs([])


def _anchor_runs(texts: list[bytes]) -> Runs:
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    buffer = np.frombuffer(b"".join(texts), np.uint8)
    none = np.empty(0, np.int64)
    if len(buffer) < SPAN:
        return none, none, none, np.empty(0, np.uint64), none
    hashes = gram_hashes(buffer)
    # the low bits hold the place: they tell which of the strings in a passage is the least
    least = (hashes & ~np.uint64(63)) | (np.arange(len(hashes), dtype=np.uint64) & np.uint64(63))
    width = 1
    while 2 * width <= WIDTH:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < WIDTH:
        least = np.minimum(least[: width - WIDTH], least[WIDTH - width :])
    usable = np.zeros(len(least), bool)
    for begin, end in zip(ends - sizes, ends):
        usable[begin : max(begin, end - SPAN + 1)] = True
    places = np.flatnonzero(usable)
    if not len(places):
        return none, none, none, np.empty(0, np.uint64), none
    at = places + ((least[places].astype(np.int64) - places) & 63)
    first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (places[1:] != places[:-1] + 1))))
    owner = np.searchsorted(ends, places[first], side="right")
    n, at_ = np.diff(first, append=len(places)), at[first] - places[first]  # at most WIDTH
    return owner.astype(np.int32), places[first] - (ends - sizes)[owner], n.astype(np.int16), hashes[at[first]], at_.astype(np.int16)


def pieces(texts: Iterator[tuple], most: int = CHUNK_BYTES, cut: int = HASHED_BYTES) -> Iterator[list[tuple]]:
    """Chunks of (id, content, offset, bytes); a long text is cut so that each passage lies in one piece."""
    chunk, size = [], 0
    for doc, content, text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        for offset in range(0, max(len(raw) - SPAN + 1, 0), min(most, cut)):
            part = raw[offset : offset + min(most, cut) + SPAN - 1]
            chunk.append((doc, content, offset, part))
            size += len(part)
            if size >= most or len(chunk) >= CHUNK_DOCS:
                yield chunk
                chunk, size = [], 0
    if chunk:
        yield chunk


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in slices(batches):
        yield from zip(*[c.to_pylist() for c in batch.columns])


def _parted(keys: np.ndarray, records: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The records of each key."""
    order = np.argsort(keys, kind="stable")
    keys, records = keys[order], records[order]
    cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else []
    for begin, end in zip(cuts, [*cuts[1:], len(keys)]):
        yield int(keys[begin]), records[begin:end]


def _as(kind: np.dtype, records: np.ndarray) -> np.ndarray:
    """The records with the fields of another kind; those they lack are zero."""
    out = np.zeros(len(records), kind)
    for name in set(kind.names) & set(records.dtype.names):
        out[name] = records[name]
    return out


def _destination(records: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(records["id"].astype(np.uint64) ^ records["content"].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[kind]) for c, (_, kind) in zip(zip(*rows), fields)], names=[name for name, _ in fields])


ANCHOR_ROWS = "bucket int, kind int, docs binary, data binary"
DEALT = "dest int, kind int, id bigint, content bigint, data binary"
FRAGMENT_ROWS = "bucket int, kind int, data binary, bytes binary"
COVER_ROWS = "dest int, data binary"
SPANS = "id bigint, content bigint, spans binary"
SINGLE, KNOWN, FOUND = 0, 1, 2


def _own_docs(docs: np.ndarray, records: np.ndarray) -> tuple[bytes, bytes]:
    """The documents that records refer to, and the records with numbers into these."""
    used, numbers = np.unique(records["doc"], return_inverse=True)
    records = records.copy()
    records["doc"] = numbers
    return packed(docs[used]), packed(records)


def _anchors(buckets: int):
    """Documents to anchors by bucket; those repeated within the chunk are found at once and sent on as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in pieces(_rows(batches)):
            owner, start, n, hashes, at = anchor_runs([p[3] for p in chunk])
            if not len(owner):
                continue
            docs = np.array([(p[0], p[1]) for p in chunk], DOC)
            start = (start + np.array([p[2] for p in chunk])[owner]).astype(np.uint32)
            del chunk
            rank = np.unique(docs, return_inverse=True)[1].astype(np.int32)  # a row's pieces have one
            order = np.lexsort((rank[owner], hashes))
            owner, start, n, hashes, at = (x[order] for x in (owner, start, n, hashes, at))
            del order
            new_hash = np.concatenate(([True], hashes[1:] != hashes[:-1]))
            row = rank[owner]
            new_row = new_hash | np.concatenate(([True], row[1:] != row[:-1]))
            head = np.flatnonzero(new_hash)
            several = np.repeat(np.add.reduceat(new_row, head, dtype=np.int64) > 1, np.diff(head, append=len(row)))
            del row, new_row, head
            bucket = ((hashes & BUCKET_MASK) % np.uint64(buckets)).astype(np.int32)
            out = []
            single = np.flatnonzero(~several)
            single = single[np.lexsort((start[single], owner[single]))]
            records = np.zeros(len(single), ANCHOR)
            records["high"], records["low"] = hashes[single] >> np.uint64(32), hashes[single] >> np.uint64(24) & np.uint64(0xFF)
            for name, values in (("start", start), ("doc", owner), ("n", n), ("at", at)):
                records[name] = values[single]
            out += [(k, SINGLE, *_own_docs(docs, r)) for k, r in _parted(bucket[single], records)]
            known = np.flatnonzero(several & new_hash)
            out += [(k, KNOWN, None, r.tobytes()) for k, r in _parted(bucket[known], hashes[known] >> np.uint64(24))]
            found = np.flatnonzero(several)
            found = found[np.lexsort((start[found], owner[found]))]
            records = np.zeros(len(found), SENT)
            records["id"], records["content"] = docs["id"][owner[found]], docs["content"][owner[found]]
            for name, values in (("start", start), ("n", n), ("at", at)):
                records[name] = values[found]
            out += [(k, FOUND, None, packed(r)) for k, r in _parted(_destination(records, buckets), records)]
            yield _batch(ANCHOR_ROWS, out)

    return run


def _repeated(buckets: int):
    """Anchors of one bucket at a time to the candidates: those met in several texts, by destination."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, singles, known = None, [], []

        def closed() -> list[tuple]:
            records = np.concatenate(singles) if singles else np.zeros(0, CAND)
            singles.clear()
            keys = np.concatenate(known) if known else np.zeros(0, np.uint64)
            known.clear()
            if not len(records):
                return []
            records = records[np.argsort(records["hash"], kind="stable")]
            h = records["hash"]
            cut = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            several = np.isin(h[cut], keys)
            for name in ("id", "content"):
                several |= np.minimum.reduceat(records[name], cut) < np.maximum.reduceat(records[name], cut)
            records = _as(SENT, records[np.repeat(several, np.diff(cut, append=len(records)))])
            records = records[np.lexsort((records["start"], records["content"], records["id"]))]
            return [(k, SINGLE, None, None, packed(r)) for k, r in _parted(_destination(records, buckets), records)]

        for bucket, kind, docs, data in _rows(batches):
            if bucket != current:
                if out := closed():
                    yield _batch(DEALT, out)
                current = bucket
            if kind == FOUND:  # its bucket is its destination
                yield _batch(DEALT, [(bucket, SINGLE, None, None, data)])
            elif kind == KNOWN:
                known.append(np.frombuffer(data, np.uint64))
            else:
                table, got = unpacked(docs, DOC), unpacked(data, ANCHOR)
                records = np.zeros(len(got), CAND)
                records["hash"] = got["high"].astype(np.uint64) << np.uint64(8) | got["low"]
                records["id"], records["content"] = table["id"][got["doc"]], table["content"][got["doc"]]
                for name in ("start", "n", "at"):
                    records[name] = got[name]
                singles.append(records)
        if out := closed():
            yield _batch(DEALT, out)

    return run


def _least(ids: np.ndarray, fragments: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The number of each fragment among the different ones, the smallest id of each of these, and these."""
    number: dict[bytes, int] = {}
    which = np.fromiter((number.setdefault(raw, len(number)) for raw in fragments), np.int64, len(fragments))
    least = np.full(len(number), np.iinfo(np.int64).max)
    np.minimum.at(least, which, ids)
    return which, least, list(number)


def _pressed(buckets: int):
    """Texts by destination, compressed: as they are, they would be the largest shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=5)
        for batch in slices(batches):
            docs, contents, texts = (c.to_pylist() for c in batch.columns)
            dests = _destination(np.array(list(zip(docs, contents)), DOC), buckets).tolist()
            yield _batch(DEALT, [(dest, KNOWN, doc, content, press.compress(text.encode("utf-8", "surrogatepass"))) for dest, doc, content, text in zip(dests, docs, contents, texts)])

    return run


def context_hashes(fragments: list[bytes], places: list[int], buckets: int) -> np.ndarray:
    """The hash of the context of fragments with one each, by the places of their anchors; its low bits are the bucket."""
    contexts = (raw[at - SIDE : at + GRAM] if at >= SIDE else raw[at : at + GRAM + SIDE + 1] for raw, at in zip(fragments, places))
    whole = np.fromiter(map(xxhash.xxh3_64_intdigest, contexts), np.uint64, len(fragments))
    return whole & ~BUCKET_MASK | (whole & BUCKET_MASK) % np.uint64(buckets)


def by_context(records: np.ndarray, fragments: list[bytes], buckets: int) -> tuple[np.ndarray, list[bytes]]:
    """Fragments cut into runs of passages with one context, whose hash and bucket replace those of the anchor.

    A passage has SIDE bytes before its anchor (where that stands in it first), or more than SIDE after it.
    These with the anchor are its context: the passage alone decides it, so equal passages meet.
    """
    owner, begin, n, at, cut = [], [], [], [], []
    for i, (raw, place, count) in enumerate(zip(fragments, records["at"].tolist(), records["n"].tolist())):
        gram, first = raw[place : place + GRAM], 0
        while first < count:
            here = raw.find(gram, first)
            end = min(here + 1, count)
            middle = min(max(here + 1 - SIDE, first), end)
            for a, b in ((first, middle), (middle, end)):
                if a < b:
                    owner.append(i)
                    begin.append(a)
                    n.append(b - a)
                    at.append(here - a)
                    cut.append(raw[a : b + SPAN - 1])
            first = end
    out = records[np.array(owner, np.int64)]
    out["start"] += np.array(begin, np.uint32)
    out["n"], out["at"] = n, at
    out["hash"] = context_hashes(cut, at, buckets)
    return out, cut


def _fragments(buckets: int):
    """Texts that meet their candidates to fragments by bucket; of equal fragments in a chunk one is sent, the later ids' are covered."""

    def emitted(held: list[np.ndarray], fragments: list[bytes]) -> pa.RecordBatch:
        records, found = np.concatenate(held), []
        for cut in (False, True):  # equal whole runs first: they are the most
            if cut:
                records, fragments = by_context(records, fragments, buckets)
            which, least, _ = _least(records["id"], fragments)
            later = records["id"] > least[which]
            found.append(_as(COVER, records[later]))
            mine = np.flatnonzero(~later)
            if not cut:
                records, fragments = records[mine], [fragments[i] for i in mine.tolist()]
        covered = np.concatenate(found)
        out = [(k, FOUND, packed(r), None) for k, r in _parted(_destination(covered, buckets), covered)]
        press = zstandard.ZstdCompressor(level=6)
        for k, picks in _parted(records["hash"][mine] & BUCKET_MASK, mine):
            out.append((k, SINGLE, packed(_as(SENT, records[picks])), press.compress(b"".join([fragments[i] for i in picks.tolist()]))))
        return _batch(FRAGMENT_ROWS, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, wanted, held, fragments, size = None, [], [], [], 0
        table, at = np.zeros(0, CAND), {}
        for dest, kind, doc, content, data in _rows(batches):
            if dest != current:
                current, wanted, table = dest, [], None
            if kind == SINGLE:
                wanted.append(_as(CAND, unpacked(data, SENT)))
                continue
            if table is None:
                table = np.concatenate(wanted) if wanted else np.zeros(0, CAND)
                wanted = []
                table = table[np.lexsort((table["start"], table["content"], table["id"]))]
                keys = np.stack([table["id"], table["content"], table["start"].astype(np.int64)])
                fresh = np.concatenate((np.ones(min(len(table), 1), bool), (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
                table, keys = table[fresh], keys[:2, fresh]  # a row met twice has its runs once
                cut = np.flatnonzero(np.concatenate((np.ones(min(len(table), 1), bool), (keys[:, 1:] != keys[:, :-1]).any(axis=0))))
                at = {k: span for k, *span in zip(zip(*keys[:, cut].tolist()), cut.tolist(), [*cut[1:].tolist(), len(table)])}
            begin, end = at.get((doc, content), (0, 0))
            if begin == end:
                continue
            mine = table[begin:end]
            raw = zstandard.decompress(data)
            starts = mine["start"].tolist()
            ends = (mine["start"].astype(np.int64) + mine["n"] + SPAN - 1).tolist()
            held.append(mine)
            fragments += [raw[a:b] for a, b in zip(starts, ends)]
            size += sum(ends) - sum(starts)
            if size >= FRAGMENT_BYTES:
                yield emitted(held, fragments)
                held, fragments, size = [], [], 0
        if held:
            yield emitted(held, fragments)

    return run


def _whole_groups(keys: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Begin and end of stretches of sorted keys, each about `most` long, that part no equal keys."""
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    edges = [0, *[b for a, b in zip([0, *cuts.tolist()], cuts.tolist()) if a // most != b // most], len(keys)]
    return ((a, b) for a, b in zip(edges, edges[1:]) if a < b)


def _earlier(chosen: np.ndarray, different: list[bytes], least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of passages (fragment, start, number) that a chosen fragment of a smaller id has too, by the transform of the chosen."""
    # bytes are shifted by one code so that zero is free for the end mark: 0xFF isn't in UTF-8
    strings = [different[i].translate(SHIFT) for i in chosen.tolist()]
    _, common, owner, start = collection_bwt(strings)
    ids = least[chosen]
    cut = np.flatnonzero(common < SPAN)
    lowest = np.repeat(np.minimum.reduceat(ids[owner], cut), np.diff(cut, append=len(owner)))
    sizes = np.array([len(raw) for raw in strings])
    hit = (lowest < ids[owner]) & (sizes[owner] - start >= SPAN)
    owner, start = owner[hit], start[hit]
    order = np.lexsort((start, owner))
    owner, start = owner[order], start[order]
    fresh = np.flatnonzero(np.concatenate((np.ones(min(len(owner), 1), bool), (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1))))
    return chosen[owner[fresh]], start[fresh], np.diff(fresh, append=len(owner))


def _by_distance(chosen: np.ndarray, different: list[bytes], least: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for one context's fragments, however many: equal passages have equal bytes at an equal distance from the anchor."""
    passages = np.array([len(different[i]) - SPAN + 1 for i in chosen.tolist()])
    out = []
    for distance in range(WIDTH):
        start = place[chosen] - distance
        some = np.flatnonzero((start >= 0) & (start < passages))
        if not len(some):
            continue
        picks, start = chosen[some], start[some]
        bytes_ = b"".join([different[i][a : a + SPAN] for i, a in zip(picks.tolist(), start.tolist())])
        _, which = np.unique(np.frombuffer(bytes_, f"V{SPAN}"), return_inverse=True)
        lowest = np.full(int(which.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(lowest, which, least[picks])
        hit = lowest[which] < least[picks]
        out.append((picks[hit], start[hit], np.ones(np.count_nonzero(hit), np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out))


def covered_runs(records: np.ndarray, fragments: list[bytes]) -> np.ndarray:
    """The runs of passages (COVER) of one bucket's fragments that start in a document with a smaller id."""
    which, least, different = _least(records["id"], fragments)
    later = records["id"] > least[which]
    out = [_as(COVER, records[later])]
    # a context with a single fragment has no other passage to compare
    hashes, place = np.zeros(len(different), np.uint64), np.zeros(len(different), np.int64)
    hashes[which], place[which] = records["hash"], records["at"]
    _, group, variants = np.unique(hashes, return_inverse=True, return_counts=True)
    open_ = np.flatnonzero(variants[group] > 1)
    if not len(open_):
        return out[0]
    # all fragments of a context go into one collection
    open_ = open_[np.argsort(group[open_], kind="stable")]
    few = variants[group[open_]] <= COLLECTION
    sorted_, many = open_[few], open_[~few]
    parts = [_earlier(sorted_[a:b], different, least) for a, b in _whole_groups(group[sorted_], COLLECTION)]
    parts += [_by_distance(many[a:b], different, least, place) for a, b in _whole_groups(group[many], 1)]
    run_owner, run_start, run_n = (np.concatenate(x) for x in zip(*parts))
    by_owner = np.argsort(run_owner, kind="stable")
    run_owner, run_start, run_n = run_owner[by_owner], run_start[by_owner], run_n[by_owner]
    # every row of the smallest id has its fragment's runs
    mine = np.flatnonzero(~later)
    mine = mine[np.argsort(which[mine], kind="stable")]
    first, last = (np.searchsorted(which[mine], run_owner, side=side) for side in ("left", "right"))
    times = last - first
    picks = mine[np.repeat(first, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
    runs = _as(COVER, records[picks])
    runs["start"] += np.repeat(run_start, times).astype(np.uint32)
    runs["n"] = np.repeat(run_n, times)
    return np.concatenate([*out, runs])


def _covered(buckets: int):
    """Fragments of one bucket at a time to covered runs of passages, by destination."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, records, fragments = None, [], []

        def closed() -> list[tuple]:
            if not records:
                return []
            every = np.concatenate(records)
            records.clear()
            order = np.argsort(every["hash"], kind="stable")
            every = every[order]
            raws = [fragments[i] for i in order.tolist()]
            fragments.clear()
            found = np.concatenate([covered_runs(every[a:b], raws[a:b]) for a, b in _whole_groups(every["hash"], LOOK)])
            found = found[np.lexsort((found["start"], found["id"]))]
            return [(k, packed(r)) for k, r in _parted(_destination(found, buckets), found)]

        for bucket, kind, data, pressed in _rows(batches):
            if bucket != current:
                if out := closed():
                    yield _batch(COVER_ROWS, out)
                current = bucket
            if kind == FOUND:
                yield _batch(COVER_ROWS, [(bucket, data)])
                continue
            sent = unpacked(data, SENT)
            raw = zstandard.decompress(pressed)
            ends = np.cumsum(sent["n"].astype(np.int64) + SPAN - 1)
            mine = [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
            got = _as(CAND, sent)
            got["hash"] = context_hashes(mine, sent["at"].tolist(), buckets)
            records.append(got)
            fragments += mine
        if out := closed():
            yield _batch(COVER_ROWS, out)

    return run


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Covered runs of one destination at a time to the removed spans of each text (pairs of begin and end)."""
    current, held = None, []

    def closed() -> list[tuple]:
        if not held:
            return []
        runs = np.concatenate(held)
        held.clear()
        runs = runs[np.lexsort((runs["start"], runs["content"], runs["id"]))]
        begin, end = runs["start"].astype(np.int64), runs["start"].astype(np.int64) + runs["n"] + SPAN - 1
        new_doc = np.concatenate(([True], (runs["id"][1:] != runs["id"][:-1]) | (runs["content"][1:] != runs["content"][:-1])))
        out = []
        heads = np.flatnonzero(new_doc)
        for a, b in zip(heads, [*heads[1:], len(runs)]):
            reach = np.maximum.accumulate(end[a:b])
            fresh = np.flatnonzero(np.concatenate(([True], begin[a + 1 : b] > reach[:-1])))
            pairs = np.stack([begin[a:b][fresh], reach[np.append(fresh[1:], b - a) - 1]], axis=1)
            out.append((int(runs["id"][a]), int(runs["content"][a]), pairs.astype("<i8").tobytes()))
        return out

    for dest, data in _rows(batches):
        if dest != current:
            if out := closed():
                yield _batch(SPANS, out)
            current = dest
        held.append(unpacked(data, COVER))
    if out := closed():
        yield _batch(SPANS, out)


def _passage_spans(long_: DataFrame) -> DataFrame:
    """id, content and spans of the texts that have passages of documents with smaller ids, in one plan."""
    size = long_.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    partitions = int(long_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(max(BUCKETS_PER_PARTITION * partitions, -(-size // BUCKET_BYTES)), 1 << BUCKET_BITS)
    anchors = mapped(long_, _anchors(buckets), ANCHOR_ROWS)
    candidates = mapped(anchors.repartition("bucket").sortWithinPartitions("bucket"), _repeated(buckets), DEALT)
    texts = mapped(long_, _pressed(buckets), DEALT)
    met = candidates.unionByName(texts).repartition("dest").sortWithinPartitions("dest", "kind")
    fragments = mapped(met, _fragments(buckets), FRAGMENT_ROWS)
    covers = mapped(fragments.repartition("bucket").sortWithinPartitions("bucket"), _covered(buckets), COVER_ROWS)
    return mapped(covers.repartition("dest").sortWithinPartitions("dest"), _spans, SPANS)


def _copies(long_: DataFrame) -> DataFrame:
    """id, content and size of the texts that a document with a smaller id has whole."""
    told = grouped_back(
        long_.select("id", "content", F.octet_length("text").cast("bigint").alias("whole"), F.md5("text").alias("digest")).withColumn("__salt", salt_of("id")),
        ["digest"], "__salt", [F.min("id").alias("__m")], [F.min("__m").alias("first")],
    )
    return told.filter("id > first").select("id", "content", "whole").distinct()


def _without(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """The rows that aren't later copies; only those that may be shuffle."""
    key = F.xxhash64("id", "content")
    told = maybe_in(rows, key, filter_of(copies.select(key.alias("k")), "k"), "maybe")
    sure = told.filter("maybe").join(copies.select("id", "content"), ["id", "content"], "left_anti")
    return told.filter("NOT maybe").unionByName(sure).select(*rows.columns)


def repeated_spans(rows: DataFrame) -> DataFrame:
    """id, content, whole and spans of every text of which something is to be removed; rows: id, content, text (no NULLs).

    Texts of equal id and content are equal.
    """
    long_ = rows.filter(F.octet_length("text") >= SPAN)
    copies = settled(_copies(long_))
    spans = settled(_passage_spans(_without(long_, copies)))
    release(rows.sparkSession)
    return spans.select("id", "content", F.lit(None).cast("bigint").alias("whole"), "spans").unionByName(copies.withColumn("spans", F.lit(None).cast("binary")))


def _several(ids: DataFrame) -> DataFrame:
    """The filter of the ids (column id, no NULLs) that several rows have: empty, so that nothing is joined with it, if there are none.

    Different ids meet in a cell by chance, more of them the more there are: those of a cell hit twice are counted.
    """
    key = F.xxhash64("id")
    told = maybe_in(ids, key, settled(repeated_filter(ids.select(key.alias("k")), "k")), "maybe")
    twice = told.filter("maybe").groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")
    return settled(filter_of(twice.select(key.alias("k")), "k"))


OUT = "n_bytes bigint, n_removed bigint, spans array<struct<begin:bigint,end:bigint>>, kept_bytes binary"


def _cut(batch: pa.RecordBatch) -> list[pa.Array]:
    sizes, removed, spans, kept = [], [], [], []
    for text, whole, pairs in zip(*[c.to_pylist() for c in batch.columns]):
        raw = text or b""
        raw = raw if isinstance(raw, bytes) else raw.encode("utf-8", "surrogatepass")
        cuts = [(0, len(raw))] if whole is not None else np.frombuffer(pairs, "<i8").reshape(-1, 2).tolist() if pairs else []
        at, rest = 0, []
        for begin, end in cuts:
            rest.append(raw[at:begin])
            at = end
        rest.append(raw[at:])
        sizes.append(len(raw))
        removed.append(sum(e - b for b, e in cuts))
        spans.append([{"begin": b, "end": e} for b, e in cuts])
        kept.append(b"".join(rest))
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    return [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())]


def _press(batch: pa.RecordBatch) -> list[pa.Array]:
    press = zstandard.ZstdCompressor(level=5)
    return [pa.array([None if raw is None else press.compress(raw) for raw in batch.column(0).to_pylist()], pa.binary())]


def _joined_and_cut(rows: DataFrame, text: str, found: DataFrame, fn: Callable[[pa.RecordBatch], list[pa.Array]], out: str) -> DataFrame:
    """rows with what fn makes of their texts and of what was found for their id and content; the texts shuffle compressed.

    Texts are decompressed and cut by one function: two in a row would need twice the Python workers at once.
    """
    raw = rows.withColumn("raw", F.col(text).cast("string").cast("binary")).drop(text)
    met = add_columns(raw, _press, "pressed binary", ["raw"], carry=False).join(found, ["id", "content"], "left")

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        raws = pa.array([None if raw is None else zstandard.decompress(raw) for raw in batch.column(0).to_pylist()], pa.binary())
        return [*fn(pa.RecordBatch.from_arrays([raws, *batch.columns[1:]], names=batch.schema.names)), raws]

    cut = add_columns(met, run, f"{out}, raw binary", ["pressed", "whole", "spans"], carry=False)
    return cut.withColumn(text, F.col("raw").cast("string").cast(rows.schema[text].dataType))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry_text: bool = True, as_text: bool = False) -> DataFrame:
    """df with n_bytes, n_removed, spans (removed byte ranges, in order) and kept_bytes (what is left).

    NULL text is empty. Rows of equal id don't remove each other's passages; those that repeat a text
    too get equal answers. Rows without an id stay whole and remove nothing. No row of an empty table.
    Columns named like a result are replaced, others may have any name. What is left may cut a character
    in two; as_text gives kept_text instead, without such halves.
    """
    rows, (own, text) = numbered(df, id_col, text_col)
    known = rows.withColumn("id", F.col(own).cast("bigint"))
    tagged = maybe_in(known, F.xxhash64("id"), _several(known.filter("id IS NOT NULL").select("id")), "several")
    tagged = tagged.withColumn("content", F.when(F.col("several"), F.xxhash64(text_of(text))).otherwise(F.lit(0).cast("bigint"))).drop("several")
    found = settled(repeated_spans(tagged.filter("id IS NOT NULL").select("id", "content", text_of(text).alias("text"))))
    release(df.sparkSession)
    key = lambda a, b: F.xxhash64(a, b)
    told = maybe_in(tagged, key("id", "content"), filter_of(found.select(key("id", "content").alias("k")), "k"), "maybe")
    plain = told.filter("NOT maybe").drop("maybe").withColumn("whole", F.lit(None).cast("bigint")).withColumn("spans", F.lit(None).cast("binary"))
    cut_text = lambda batch: (lambda c: [*c[:3], pa.array([b.decode("utf-8", "ignore") for b in c[3].to_pylist()], pa.string())])(_cut(batch))
    fn, out = (cut_text, OUT.replace("kept_bytes binary", "kept_text string")) if as_text else (_cut, OUT)
    results = ["n_bytes", "n_removed", "spans", "kept_text" if as_text else "kept_bytes"]
    names = [c for c in rows.columns if carry_text or c != text] + results
    plain = add_columns(plain, fn, out, [text, "whole", "spans"], carry=carry_text).select(*names)
    cut = _joined_and_cut(told.filter("maybe").drop("maybe"), text, found, fn, out).select(*names)
    return renamed(plain.unionByName(cut), df.columns, results, [] if carry_text else [df.columns[int(text)]])


def digest(df: DataFrame) -> DataFrame:
    rows = remove_repeats(df.select("doc_id", "text"), carry_text=False)
    return rows.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"))
