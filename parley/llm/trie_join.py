"""N-gram Jaccard join with prefix trees, exact, one class id per document.

1. Every text becomes its set of distinct shingle hashes; equal sets share a set
   id (64-bit digest of the hashes), so copies cost one set.
2. Hashes go, packed into binary cells, to buckets by value. A bucket counts in
   how many sets each n-gram is; one that only a single set holds cannot be in an
   overlap and ends there.
3. Back at its set, the shared n-grams must make up the threshold's share of the
   set, or the set has no partner. What is left is ordered by (frequency, hash):
   the global order, rare n-grams first.
4. Two similar sets share an n-gram among the first ``n - ceil(t n) + 1`` of each.
   Sets joined by such n-grams form blocks, found by star contraction.
5. In a block the sets form a trie, frequent n-grams first so that near copies
   share paths. A batch of sets walks it together: overlaps of a path are counted
   once for all sets below it, and a subtree is left as soon as the n-grams that
   remain on either side cannot reach the threshold, or when all in it already
   belong to the component of the walking set. Only links that join components
   are returned: at most one less than there are sets.
6. A block above ``BLOCK`` sets is cut into parts that each walk their own trie,
   with a few common sets in every part. Sets outside the largest component found
   so far then walk the tries of all parts; pairs inside it need no further link.

Step 6 is where a family whose members mostly do not link stays quadratic.

Defined cases: a null or empty text has no n-grams and its own id as component; a
text of fewer words than an n-gram is one n-gram of all its words; equal texts
link through their set; a long text is held whole by its task, with its n-grams;
repeated rows are kept; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import components, partitions
from .words import mix, shingles, slices, words

BLOCK = 1500  # sets whose trie one task builds
PIVOTS = 8  # sets that all parts of a large block share
WALKERS = 256  # sets that walk a trie together
FLUSH = 1_500_000  # n-grams a task gathers before it packs them
LOW40 = np.uint64((1 << 40) - 1)
RUN = 255  # n-grams a packed header counts
SIZES = -1  # in place of a bucket: sizes of sets
CELLS = 1 << 26  # walkers times distinct n-grams of a block that are held at once


def _sets(batches: Iterator[pa.RecordBatch], k: int):
    """(batch, set ids, set sizes, distinct hashes of all sets, their bounds)."""
    for batch in slices(batches, "text"):
        w = words(batch.column("text"))
        h, begin = shingles(w.hash, w.first, k)
        doc = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[new], doc[new]
        bounds = np.searchsorted(doc, np.arange(len(begin)))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(0xA5A5A5A5)), dtype=np.uint64)])
        size = np.diff(bounds)
        yield batch, mix(sums[bounds[1:]] - sums[bounds[:-1]] + size.astype(np.uint64)), size, h, bounds


def _members(batches, k: int):
    for batch, sid, size, _, _ in _sets(batches, k):
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(sid.view(np.int64), pa.int64(), mask=size == 0)],
            ["doc_id", "n_shingles", "set_id"],
        )


PACKED = "bucket int, sid binary, cnt binary, lo binary, hi binary"
_NAMES = ["sid", "cnt", "lo", "hi"]


def _cells(key: np.ndarray, sid: np.ndarray, h: np.ndarray, extra: dict | None = None) -> list[list]:
    """Rows of packed n-grams by ``key``; elements of one set are neighbours and share a header of 9 bytes."""
    order = np.argsort(key, kind="stable")
    key, sid, h = key[order], sid[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (sid[1:] != sid[:-1]) | (key[1:] != key[:-1])
    head = np.flatnonzero(new)
    since = np.arange(len(h)) - np.repeat(head, np.diff(np.append(head, len(h))))
    head = np.flatnonzero(since % RUN == 0)  # a long run has several headers
    cnt = np.diff(np.append(head, len(h))).astype(np.uint8)
    cut = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(h) else np.zeros(0, np.int64)
    stop = np.append(cut[1:], len(h))
    at, to = np.searchsorted(head, cut), np.searchsorted(head, stop)
    lo, hi = h.astype(np.uint32), ((h & LOW40) >> np.uint64(32)).astype(np.uint8)
    hsid = sid[head]
    more = {c: v[order] for c, v in (extra or {}).items()}
    return [
        [int(key[a]), hsid[u:v].tobytes(), cnt[u:v].tobytes(), lo[a:b].tobytes(), hi[a:b].tobytes(),
         *[v2[a:b].tobytes() for v2 in more.values()]]
        for a, b, u, v in zip(cut, stop, at, to)
    ]


def _open(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Set id and 40-bit n-gram of every element."""
    get = lambda c, t: np.frombuffer(b"".join(frame[c]), t)
    cnt = get("cnt", np.uint8)
    h = get("lo", np.uint32).astype(np.uint64) | (get("hi", np.uint8).astype(np.uint64) << np.uint64(32))
    return np.repeat(get("sid", np.uint64), cnt), h


def _pack(batches, k: int, buckets: int):
    seen: set[int] = set()
    held: list[tuple] = []
    total = 0

    def flush():
        sid, h = (np.concatenate(x) for x in zip(*held))
        key = (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.uint16)
        rows = _cells(key, sid, h)
        kinds = [pa.int32(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["bucket", *_NAMES])

    for _, sid, size, h, _ in _sets(batches, k):
        new = np.array([s not in seen for s in sid.tolist()], bool) & (size > 0)
        _, first = np.unique(sid, return_index=True)
        once = np.zeros(len(sid), bool)
        once[first] = True
        new &= once
        seen.update(sid[new].tolist())
        keep = np.repeat(new, size)
        held.append((np.repeat(sid, size)[keep], h[keep]))
        total += int(keep.sum())
        if total >= FLUSH:
            yield flush()
            held, total = [], 0
            seen.clear()
    if total:
        yield flush()


SHARED = "dest int, bucket int, sid binary, cnt binary, lo binary, hi binary, df binary"


def _dest(sid: np.ndarray, dests: int) -> np.ndarray:
    return (sid >> np.uint64(32)) % np.uint64(dests)


def _sizes(batches, dests: int):
    """Sizes of the sets, dealt as their shared n-grams are; a set may come several times."""
    for batch in batches:
        sid = batch.column("set_id").to_numpy(zero_copy_only=False).view(np.uint64)
        n = batch.column("n_shingles").to_numpy(zero_copy_only=False).astype(np.uint32)
        _, one = np.unique(sid, return_index=True)
        sid, n = sid[one], n[one]
        dest = _dest(sid, dests)
        rows = [(int(d), SIZES, sid[dest == d].tobytes(), b"", n[dest == d].tobytes(), b"", b"") for d in np.unique(dest)]
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["dest", "bucket", *_NAMES, "df"])


def _shared(frame: pd.DataFrame, dests: int) -> pd.DataFrame:
    """N-grams of one bucket that at least two sets hold, dealt by set."""
    sid, h = _open(frame)
    order = np.argsort(h, kind="stable")
    sid, h = sid[order], h[order]
    near = np.zeros(len(h), bool)
    same = h[1:] == h[:-1]
    near[1:] |= same
    near[:-1] |= same
    sid, h = sid[near], h[near]
    order = np.lexsort((sid, h))
    sid, h = sid[order], h[order]
    new = np.ones(len(h), bool)  # a set that several tasks sent counts once
    new[1:] = (h[1:] != h[:-1]) | (sid[1:] != sid[:-1])
    sid, h = sid[new], h[new]
    head = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    runs = np.diff(np.append(head, len(h)))
    df = np.repeat(runs, runs)
    keep = df > 1
    sid, h, df = sid[keep], h[keep], np.minimum(df[keep], 65535).astype(np.uint16)
    order = np.argsort(sid, kind="stable")
    sid, h, df = sid[order], h[order], df[order]
    rows = _cells(_dest(sid, dests), sid, h, {"df": df})
    out = pd.DataFrame(rows, columns=["dest", *_NAMES, "df"])
    out.insert(1, "bucket", int(frame["bucket"].iloc[0]))
    return out


SETS = "set_id long, n int, grams binary, prefix array<long>"


def _survivors(frame: pd.DataFrame, num: int, den: int) -> pd.DataFrame:
    """Sets whose shared n-grams reach the threshold, in global order."""
    known = frame[frame["bucket"] == SIZES]
    size_of = np.frombuffer(b"".join(known["sid"]), np.uint64), np.frombuffer(b"".join(known["lo"]), np.uint32)
    by_id = np.argsort(size_of[0], kind="stable")
    ids, sizes = size_of[0][by_id], size_of[1][by_id].astype(np.int64)
    frame = frame[frame["bucket"] != SIZES]
    sid, h = _open(frame)
    per_row = [len(x) // 4 for x in frame["lo"]]
    bucket = np.repeat(frame["bucket"].to_numpy(np.uint64), per_row)
    df = np.frombuffer(b"".join(frame["df"]), np.uint16)
    gram = h | (bucket << np.uint64(48))
    order = np.lexsort((gram, df, sid))
    sid, gram = sid[order], gram[order]
    n = sizes[np.searchsorted(ids, sid)]
    head = np.flatnonzero(np.append(True, sid[1:] != sid[:-1])) if len(sid) else np.zeros(0, np.int64)
    rows = []
    for a, b in zip(head, np.append(head[1:], len(sid))):
        size, shared = int(n[a]), int(b - a)
        need = -(-num * size // den)  # an overlap is at least the threshold's share of each side
        if shared >= need:
            own = gram[a:b]
            rows.append((int(sid[a : a + 1].view(np.int64)[0]), size, own.tobytes(), own[: shared - need + 1].view(np.int64).tolist()))
    return pd.DataFrame(rows, columns=["set_id", "n", "grams", "prefix"])


def trie_links(
    grams: list[np.ndarray], sizes: np.ndarray, num: int, den: int,
    walking: np.ndarray | None = None, label: np.ndarray | None = None,
) -> list[tuple[int, int]]:
    """Links that join components of the sets, found by walking their trie.

    ``sizes`` are the sizes of the whole sets, n-grams that no other set holds
    included. ``walking`` marks the sets that walk (all by default), ``label``
    the components known before. Indexes into ``grams`` are returned.
    """
    m = len(grams)
    sizes = np.asarray(sizes, np.int64)
    label = np.arange(m) if label is None else np.unique(label, return_inverse=True)[1]
    flat = np.concatenate(grams) if m else np.zeros(0, np.uint64)
    _, back, count = np.unique(flat, return_inverse=True, return_counts=True)
    rank_of = np.empty(len(count), np.int64)
    common = np.argsort(-count, kind="stable")
    rank_of[common] = np.arange(len(count))
    ranks = rank_of[back]
    bounds = np.concatenate([[0], np.cumsum([len(g) for g in grams])])
    paths = [np.sort(ranks[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
    order = sorted(range(m), key=lambda i: paths[i].astype(">u4").tobytes())
    lcp = np.zeros(m + 1, np.int64)
    for j in range(1, m):
        a, b = paths[order[j - 1]], paths[order[j]]
        short = min(len(a), len(b))
        differ = np.flatnonzero(a[:short] != b[:short])
        lcp[j] = differ[0] if len(differ) else short
    depth = np.array([len(paths[i]) for i in order], np.int64)
    size = sizes[order]
    lab = label[order]
    walkers = np.arange(m) if walking is None else np.flatnonzero(np.asarray(walking)[order])
    links: list[tuple[int, int]] = []
    width = len(count)
    together = int(max(1, min(WALKERS, CELLS // max(width, 1))))
    for w0 in range(0, len(walkers), together):
        who = walkers[w0 : w0 + together]
        has = np.zeros((len(who), width), bool)
        for j, x in enumerate(who):
            has[j, paths[order[x]]] = True
        stack = [(0, m, 0, np.arange(len(who)), np.zeros(len(who), np.int64))]
        while stack:
            lo, hi, at, active, overlap = stack.pop()
            under = lab[lo:hi]
            if (under == under[0]).all():
                go = lab[who[active]] != under[0]
                active, overlap = active[go], overlap[go]
            own = size[who[active]]
            least, most = size[lo:hi].min(), size[lo:hi].max()
            go = (num * least <= den * own) & (num * own <= den * most)
            active, overlap, own = active[go], overlap[go], own[go]
            if not len(active):
                continue
            to = int(lcp[lo + 1 : hi].min()) if hi - lo > 1 else int(depth[lo])
            step = paths[order[lo]][at:to]
            if len(step):
                overlap = overlap + has[active[:, None], step].sum(1)
                left = depth[who[active]] - np.array([np.searchsorted(paths[order[x]], step[-1], "right") for x in who[active]])
                need = -(-num * (own + least) // (num + den))
                go = overlap + np.minimum(left, depth[lo:hi].max() - to) >= need
                active, overlap, own = active[go], overlap[go], own[go]
                if not len(active):
                    continue
            ends = lo
            while ends < hi and depth[ends] == to:  # sets that end here come first
                linked = den * overlap >= num * (own + size[ends] - overlap)
                linked &= who[active] != ends
                for x in who[active[linked]]:
                    if lab[x] != lab[ends]:
                        links.append((order[x], order[ends]))
                        lab[lab == lab[x]] = lab[ends]
                ends += 1
            if ends < hi:
                cuts = [ends, *(ends + 1 + np.flatnonzero(lcp[ends + 1 : hi] == to)).tolist(), hi]
                for a, b in zip(cuts[:-1], cuts[1:]):
                    stack.append((a, b, to, active, overlap))
    return links


LINKS = "a long, b long"


def _links_of(frame: pd.DataFrame, num: int, den: int) -> pd.DataFrame:
    """Links of one group: by block, the group's sets walk the trie of all of them."""
    out = []
    for _, block in frame.groupby("block", sort=False):
        block = block.drop_duplicates("set_id")
        grams = [np.frombuffer(g, np.uint64) for g in block["grams"]]
        known = block["known"].to_numpy() if "known" in block else None
        walking = block["walks"].to_numpy() if "walks" in block else None
        ids = block["set_id"].to_numpy()
        out += [(ids[i], ids[j]) for i, j in trie_links(grams, block["n"].to_numpy(), num, den, walking, known)]
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def set_components(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(members, classes): ``doc_id, n_shingles, set_id`` and ``set_id, class`` of linked sets."""
    spark = docs.sparkSession
    n = partitions(spark)
    buckets = min(max(1, n // 2), 65535)  # few, so that a set's n-grams share headers
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    id_type = dict(texts.dtypes)["doc_id"]
    members = cut_lineage(texts.mapInArrow(lambda b: _members(b, k), f"doc_id {id_type}, n_shingles long, set_id long"))
    packed = texts.mapInArrow(lambda b: _pack(b, k, buckets), PACKED)
    shared = packed.groupBy("bucket").applyInPandas(lambda f: _shared(f, buckets), SHARED)
    sizes = members.where("set_id is not null").select("set_id", "n_shingles").mapInArrow(lambda b: _sizes(b, buckets), SHARED)
    sets = cut_lineage(shared.union(sizes).groupBy("dest").applyInPandas(lambda f: _survivors(f, num, den), SETS))

    grams = sets.select("set_id", F.explode("prefix").alias("g"))
    hubs = grams.groupBy("g").agg(F.min("set_id").alias("hub"), F.count(F.lit(1)).alias("c")).where("c > 1")
    near = grams.join(hubs, "g").where("set_id > hub").select(F.col("set_id").alias("a"), F.col("hub").alias("b")).distinct()
    blocks = components(near).withColumnRenamed("node", "set_id").withColumnRenamed("component", "block")
    many = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("c"), F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    blocks = cut_lineage(blocks.join(many, "block"))
    placed = sets.drop("prefix").join(blocks, "set_id")
    small = placed.where("parts = 1").withColumn("task", F.pmod(F.xxhash64("block"), F.lit(4 * n)))
    links = small.select("task", "block", "set_id", "n", "grams").groupBy("task").applyInPandas(
        lambda f: _links_of(f, num, den), LINKS
    )
    part = F.pmod(F.xxhash64("set_id"), F.col("parts"))
    large = placed.where("parts > 1").withColumn("part", part.cast("int"))
    if blocks.where("parts > 1").limit(1).count():
        pivot = F.pmod(F.xxhash64("set_id", F.lit(1)), F.greatest(F.floor(F.col("c") / PIVOTS), F.lit(1))) == 0
        spread = F.when(pivot, F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))).otherwise(F.array("part"))
        first = large.withColumn("at", F.explode(spread)).select("block", "at", "set_id", "n", "grams")
        inside = cut_lineage(first.groupBy("block", "at").applyInPandas(lambda f: _links_of(f, num, den), LINKS))
        known = components(inside).toDF("set_id", "known")
        large = large.join(known, "set_id", "left").withColumn("known", F.coalesce("known", "set_id"))
        large = cut_lineage(large)
        sizes = large.groupBy("block", "known").count()
        top = sizes.groupBy("block").agg(F.max_by("known", F.struct("count", "known")).alias("top"))
        rest = large.join(top, "block").where("known != top").drop("top")
        chunks = rest.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("chunks"))
        rest = rest.join(chunks, "block").withColumn("chunk", F.pmod(F.xxhash64("set_id", F.lit(2)), F.col("chunks")).cast("int"))
        cols = ["block", "part", "chunk", "set_id", "n", "grams", "known", "walks"]
        walk = rest.withColumn("part", F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int")))).withColumn("walks", F.lit(True))
        stay = large.join(chunks, "block").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("walks", F.lit(False))
        across = walk.select(*cols).union(stay.select(*cols)).groupBy("block", "part", "chunk").applyInPandas(
            lambda f: _links_of(f.sort_values("walks", ascending=False, kind="stable"), num, den), LINKS
        )
        links = links.union(inside).union(across)
    return members, components(links).toDF("set_id", "class")


def similar_documents(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """``doc_id, n_shingles, component_id``: classes of documents linked at ``num / den`` or more.

    The component is the smallest id that links reach, the document's own id
    where nothing links.
    """
    members, classes = set_components(docs, k, num, den)
    by_set = members.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("low"))
    by_set = by_set.join(classes, "set_id", "left").withColumn("class", F.coalesce("class", "set_id"))
    lowest = by_set.groupBy("class").agg(F.min("low").alias("component_id"))
    lowest = by_set.join(lowest, "class").select("set_id", "component_id")
    return members.join(lowest, "set_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )
