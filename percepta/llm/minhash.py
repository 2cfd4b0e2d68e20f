"""MinHash near-dedup of texts by min-max hashing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from percepta.shared import CROWD, connected_components, freed, lookup_join, packed, written

#: Permutations; each gives a minimum and a maximum. A band takes two permutations, so four values.
PERMUTATIONS = 48
BLOCK = 1024
#: Members that are verified against one copy of their centre.
STAR = 512
#: Bands of each round: pairs that meet in the first bands are settled, and mostly joined, before the other bands are looked at.
ROUNDS = ((0, 4), (4, PERMUTATIONS // 2))
#: Shingles of the residents whose full sets one task holds at once, unless a single text has more.
SHINGLES = 1 << 22
#: Ranges of hashes of which a sketch keeps a byte each.
BIN_BITS = 10
BINS = 1 << BIN_BITS
#: Shingles that are hashed under all permutations at once.
CHUNK = 2048


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of an A-Z lower-cased text; with fewer words, one of them all."""
    import xxhash

    found = (text or b"").lower().split()
    n = len(found)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, n)
    width = min(n, k)
    acc = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        acc = _mixed(acc * np.uint64(0x9E3779B97F4A7C15) + h[i : n - width + 1 + i])
    return np.unique(acc)


def signature(shingles: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Minima and maxima under each permutation, as (PERMUTATIONS, 2)."""
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(len(factors), np.uint64)
    for lo in range(0, len(shingles), CHUNK):
        x = (shingles[None, lo : lo + CHUNK] ^ shifts[:, None]) * factors[:, None]
        low, high = np.minimum(low, x.min(1)), np.maximum(high, x.max(1))
    return np.stack([low, high], 1)


def permutations(seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return tuple(rng.integers(0, 2**64, PERMUTATIONS, dtype=np.uint64) | np.uint64(b) for b in (1, 0))


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A key for each pair of permutations, from its two minima and two maxima."""
    v = sig.reshape(PERMUTATIONS // 2, 4)
    h = np.arange(len(v), dtype=np.uint64)
    for k in range(4):
        h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + v[:, k])
    return h.astype(np.int64)


def _signed(k: int, seed: int):
    def sign(batches: Iterable) -> Iterator:
        import pyarrow as pa

        factors, shifts = permutations(seed)
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for at in range(0, batch.num_rows, 500):
                part = texts.slice(at, 500).to_pylist()
                cids, sizes, keys, bands, last = [], [], [], [], {}
                for text in part:
                    key = hashlib.md5(text or b"").digest()
                    if key not in last:  # copies often stand close together
                        s = shingle_set(text, k)
                        last[key] = (hashlib.md5(s.tobytes()).digest(), len(s), band_keys(signature(s, factors, shifts))) if len(s) else (None, 0, [])
                    cid, n, b = last[key]
                    cids.append(cid)
                    sizes.append(n)
                    keys.append(key)
                    bands.append(b)
                flat = np.concatenate([np.asarray(b, np.int64) for b in bands]) if bands else np.zeros(0, np.int64)
                offsets = np.concatenate([[0], np.cumsum([len(b) for b in bands])]).astype(np.int32)
                columns = [batch.column(0).slice(at, 500), pa.array(keys, pa.binary()), pa.array(cids, pa.binary()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tk", "cid", "n_shingles", "bands"])

    return sign


def _confirmed(k: int, percent: int):
    """Streams stars, the centre's text first: yields the members whose full shingle sets are similar enough."""

    def confirm(batches: Iterable) -> Iterator:
        import pyarrow as pa

        at = centre = None
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            a, b = [], []
            for i, (hub, salt, member) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("hub", "salt", "member")), strict=True)):
                own = shingle_set(texts[i].as_py(), k)
                if not member:
                    at, centre = (hub, salt), own
                    continue
                if at != (hub, salt):
                    raise ValueError("a star without its centre")
                both = len(np.intersect1d(centre, own, assume_unique=True))
                if 100 * both >= percent * (len(centre) + len(own) - both):
                    a.append(hub)
                    b.append(member)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return confirm


def _marked(docs: DataFrame) -> DataFrame:
    """docs with a key of its rows that has no nulls: id, whether there is none, digest of the text."""
    return docs.select(*_row_key("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))), "text")


def _row_key(doc_id: str, digest) -> list:
    return [F.coalesce(doc_id, F.lit(-1)).alias("d"), F.col(doc_id).isNull().alias("no"), digest.alias("tk")]


def _texts_of(wanted: DataFrame, classes: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """wanted(cid, …) without cid, with the text that stands for each class. Only these texts travel. Repeated rows of one id and text give repeated rows."""
    at = classes.select("cid", *_row_key("rep.doc_id", F.col("rep.tk")))
    rows = written(wanted.join(at, "cid").drop("cid"), f"{name}-wanted")
    return lookup_join(_marked(docs), rows, ["d", "no", "tk"], "inner", spread=[F.col("tk")]).drop("d", "no", "tk")


def _with_texts(wanted: DataFrame, classes: DataFrame, docs: DataFrame, keys: list[str], name: str) -> DataFrame:
    """wanted(cid, keys…) with the text that stands for each class, one row for each of keys."""
    return _texts_of(wanted, classes, docs, name).groupBy(*keys).agg(F.first("text").alias("text"))


def _verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int, name: str) -> DataFrame:
    """Of pairs(hub, member), those whose full sets are similar enough. Only texts in pairs travel; large stars are dealt over several tasks."""
    pairs = written(pairs.distinct(), f"{name}-pairs")
    if not pairs.limit(1).count():
        return pairs.toDF("a", "b")
    degree = written(pairs.groupBy("hub").agg(F.ceil(F.count("*") / STAR).cast("int").alias("salts")), f"{name}-degrees")
    members = pairs.join(degree, "hub").select("hub", F.pmod(F.xxhash64("member"), F.col("salts")).cast("int").alias("salt"), "member", F.col("member").alias("cid"))
    centres = degree.select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(b"").alias("member"), F.col("hub").alias("cid"))
    stars = _with_texts(centres.unionByName(members), classes, docs, ["hub", "salt", "member"], name)
    stars = stars.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "member")
    out = written(stars.mapInArrow(_confirmed(k, percent), "a binary, b binary"), f"{name}-links")
    freed(pairs, degree)
    return out


def _sketched(k: int):
    def sketch(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            made = [sketch_of(shingle_set(t.as_py(), k)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.array(made, pa.binary())], names=["cid", "sketch"])

    return sketch


def sketch_of(shingles: np.ndarray) -> bytes:
    """A byte for each of BINS ranges of hashes, from the least hash in it; 0 where there is none."""
    bins, first = np.unique(shingles >> np.uint64(64 - BIN_BITS), return_index=True)
    out = np.zeros(BINS, np.uint8)
    out[bins.astype(np.int64)] = 1 + shingles[first] % np.uint64(255)
    return out.tobytes()


def may_be_similar(sketches: np.ndarray, rows: np.ndarray, filled: np.ndarray, sizes: np.ndarray, own: np.ndarray, size: int, share: float) -> np.ndarray:
    """Which rows of sketches, of so many filled bins, may belong to sets whose similarity with own reaches share.

    The estimate is the share of equal bins among those that either fills, a sample of the union without replacement: its
    variance shrinks as the bins hold all of the union. Four standard deviations and two bins are allowed for.
    """
    bins = np.flatnonzero(own)
    there = sketches[np.ix_(rows, bins)]
    equal = np.count_nonzero(there == own[bins], 1)
    either = np.maximum(filled + len(bins) - np.count_nonzero(there, 1), 1)
    union = np.maximum((sizes + size) / (1 + share), either)
    slack = 4 * np.sqrt(share * (1 - share) / either * (1 - either / union) + 1e-9) + 2 / either
    return equal / either >= share - slack


def _crossed(percent: int):
    """Streams buckets, residents first: the rows with a partner of another component in the bucket whose sketch allows the similarity.

    A pair is looked at in the first band that its two rows share only: both are in that bucket, and in its other ones again.
    """

    share = percent / 100

    def cross(batches: Iterable) -> Iterator:
        import pyarrow as pa

        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64()]
        at, ids, names, out = None, [], {}, []
        matrix, keys = np.zeros((16, BINS), np.uint8), np.zeros((16, PERMUTATIONS // 2), np.int64)
        labels, sizes, filled, hit = (np.zeros(16, np.int64) for _ in range(4))

        def drained() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * 4
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=["key", "cid", "label", "n"])

        def close() -> None:
            for i in np.flatnonzero(hit[: len(ids)]).tolist():
                out.append((at[0], *ids[i], int(sizes[i])))
            hit[:] = 0

        for batch in batches:
            bands = batch.column("bands").flatten().to_numpy().reshape(batch.num_rows, PERMUTATIONS // 2)
            for key, block, cid, label, n, raw, home, own_keys in zip(*(batch.column(c).to_pylist() for c in ("key", "block", "cid", "label", "n", "sketch", "home")), bands, strict=True):
                if (key, block) != at:
                    close()
                    at, ids, names = (key, block), [], {}
                own, tag, m = np.frombuffer(raw, np.uint8), names.setdefault(label, len(names)), len(ids)
                fits = np.minimum(sizes[:m], n) >= share * np.maximum(sizes[:m], n) - 1e-9
                other = np.flatnonzero(fits & (labels[:m] != tag))
                if len(other):
                    other = other[own_keys[(keys[other] == own_keys).argmax(1)] == key]
                if len(other):
                    other = other[may_be_similar(matrix, other, filled[other], sizes[other], own, n, share)]
                    hit[other] = 1
                if home:
                    if m == len(matrix):
                        matrix, keys, labels, sizes, filled, hit = (np.concatenate([x, np.zeros_like(x)]) for x in (matrix, keys, labels, sizes, filled, hit))
                    matrix[m], keys[m], labels[m], sizes[m], filled[m], hit[m] = own, own_keys, tag, n, np.count_nonzero(own), len(other) > 0
                    ids.append((cid, label))
                elif len(other):
                    out.append((key, cid, label, n))
            yield drained()
        close()
        yield drained()

    return cross


class Block:
    """Full sets of the residents of a block as one sorted index, which gives a set's intersections with all of them at once."""

    def __init__(self, percent: int):
        self.percent, self.rows, self.sets, self.parent = percent, [], [], {}
        self.hashes = None

    def _root(self, x):
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = x = self.parent.get(up, up)
        return x

    def add(self, cid: bytes, label: bytes, own: np.ndarray) -> None:
        self.rows.append((cid, label))
        self.sets.append(own)

    def closed(self) -> Iterator[tuple[bytes, bytes]]:
        """After the last resident: builds the index and gives the residents' links among themselves."""
        if self.hashes is None and self.rows:
            self.sizes = np.array([len(s) for s in self.sets])
            hashes = np.concatenate(self.sets)
            order = np.argsort(hashes)
            self.hashes, self.owners = hashes[order], np.repeat(np.arange(len(self.sets), dtype=np.int32), self.sizes)[order]
            for m, ((cid, label), own) in enumerate(zip(self.rows, self.sets, strict=True)):
                yield from self.links(cid, label, own, m)
            self.sets = []

    def links(self, cid: bytes, label: bytes, own: np.ndarray, m: int | None = None) -> Iterator[tuple[bytes, bytes]]:
        """Links of a row with the first m residents (all), but for those of components that the block's links already join."""
        if not self.rows or m == 0:
            return
        lo, hi = np.searchsorted(self.hashes, own, "left"), np.searchsorted(self.hashes, own, "right")
        counts = hi - lo
        at = np.repeat(hi - counts.cumsum(), counts) + np.arange(counts.sum())
        both = np.bincount(self.owners[at], minlength=len(self.rows))[:m]
        for i in np.flatnonzero(100 * both >= self.percent * (self.sizes[:m] + len(own) - both)).tolist():
            a, b = self._root(label), self._root(self.rows[i][1])
            if a != b:
                self.parent[max(a, b)] = min(a, b)
                yield cid, self.rows[i][0]


def _compared(k: int, percent: int):
    """Streams blocks of buckets, residents first: links between different components, confirmed on full sets, at most one for each row that they join."""

    def compare(batches: Iterable) -> Iterator:
        import pyarrow as pa

        at = last = None
        block, out = Block(percent), []

        def drained() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.binary()) for i in (0, 1)], names=["a", "b"])
            out.clear()
            return made

        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for i, (key, number, home, label, cid) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("key", "block", "home", "label", "own")), strict=True)):
                if (key, number) != at:
                    out.extend(block.closed())
                    at, last, block = (key, number), None, Block(percent)
                if cid == last:  # a repeated row that stands for the class again
                    continue
                last, own = cid, shingle_set(texts[i].as_py(), k)
                if home:
                    block.add(cid, label, own)
                else:
                    out.extend(block.closed())
                    out.extend(block.links(cid, label, own))
            yield drained()
        out.extend(block.closed())
        yield drained()

    return compare


def _open(met: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows of the buckets that hold several components, with these."""
    labelled = written(met.join(parts, "cid", "left").select("key", "band", "cid", "homes", F.coalesce("component", "cid").alias("label")), "labelled")
    mixed = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max(F.ceil(F.col("homes") / BLOCK)).cast("int").alias("blocks")).filter("lo <> hi").select("key", "blocks")
    out = written(labelled.join(mixed, "key").select("key", "band", "cid", "label", "blocks"), "open")
    freed(labelled)
    return out


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows of buckets dealt over their blocks: each row lives in one, home, and visits those before it, so two rows of a bucket meet once."""
    rows = rows.withColumn("own_block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    return rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("own_block")))).withColumn("home", F.col("block") == F.col("own_block"))


def _links_across(open_rows: DataFrame, sketches: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int, name: str) -> DataFrame:
    """Links between components of one bucket. A text travels once to each block of those of its buckets in which a sketch allows a link; pairs never do."""
    dealt = _dealt(open_rows.join(sketches, "cid")).select("key", "block", "cid", "label", "n", "bands", "sketch", "home")
    dealt = dealt.repartition("key", "block").sortWithinPartitions("key", "block", F.col("home").desc())
    wanted = written(dealt.mapInArrow(_crossed(percent), "key long, cid binary, label binary, n long").distinct(), f"{name}-rows")
    sized = wanted.groupBy("key").agg(F.ceil(F.sum("n") / SHINGLES).cast("int").alias("blocks"))
    rows = _dealt(wanted.join(sized, "key")).select("cid", "key", "block", "home", "label", F.col("cid").alias("own"))
    texts = _texts_of(rows, classes, docs, name).repartition("key", "block").sortWithinPartitions("key", "block", F.col("home").desc(), "own")
    out = written(texts.mapInArrow(_compared(k, percent), "a binary, b binary"), f"{name}-links")
    freed(wanted)
    return out


def near_documents(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", seed: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, the digest tk of the text and the key of its group for every row of docs.

    A text's set: the distinct k-word shingles of its words (runs without ASCII blanks, A-Z lower-cased); with fewer
    words, one shingle of them all; none without words. Texts link if 100 * |both| >= percent * |either|, on full sets
    of 64-bit hashes. Null and empty texts have n_shingles 0 and link with nothing. component_id is the least id that links reach.

    Texts with equal sets form a class. Each class has min-max values under 48 permutations, banded by four values in 24
    bands: of two texts at 0.8, fewer than one pair in 100,000 shares no band. In each band bucket all classes are first
    verified against the bucket's least class: one row each, however large the bucket. Links found join components; then rows
    of one bucket in different components are compared by sketches of 1,024 bytes. Rows whose sketches allow a link send their texts
    to the bucket once, or once for each of its blocks of 4 million shingles, and are compared there on full sets; pairs are never written. Components already joined need no check.
    Large buckets are dealt over blocks and large stars over copies of their centre, so no task holds a whole group.
    Null or repeated ids are rows like any other: the group comes from the texts' sets, so two texts that don't link differ in
    it whatever their ids are. It is null without words.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = written(docs.mapInArrow(_signed(k, seed), "doc_id long, tk binary, cid binary, n_shingles long, bands array<bigint>"), "signed")
    kinds = rows.filter("cid is not null").groupBy("cid")
    classes = kinds.agg(F.first("bands").alias("bands"), F.first("n_shingles").alias("n"), F.min(F.struct("doc_id", "tk")).alias("rep"), F.min("doc_id").alias("least_id"), F.count("*").alias("copies"))
    classes = written(classes, "classes")
    # Only keys travel to find the buckets of several classes; only the rows in these go on.
    keys = F.explode("bands").alias("key")
    shared = written(classes.select(keys).groupBy("key").agg(F.count("*").alias("homes")).filter("homes > 1"), "shared-keys")
    crowded = shared.filter(F.col("homes") > CROWD).select("key")
    met = written(lookup_join(classes.select("cid", "n", F.posexplode("bands").alias("band", "key")), shared, ["key"], "inner", most_rows=1_000_000, spread=[F.col("cid")], crowded=crowded), "met")
    leads = met.groupBy("key").agg(F.min(F.struct("cid", "n")).alias("lead"))
    fit = F.least("n", "lead.n") * 100 >= F.greatest("n", "lead.n") * percent
    starred = met.join(leads, "key").filter(fit & (F.col("cid") != F.col("lead.cid"))).select(F.col("lead.cid").alias("hub"), F.col("cid").alias("member"))
    links = _verify(starred, classes, docs, k, percent, "stars")
    parts = connected_components(links).withColumnRenamed("node", "cid")

    sketches = None
    for step, (first, last) in enumerate(ROUNDS):
        open_rows = _open(met if sketches is None else met.filter(F.col("band") >= first), parts)
        if sketches is None:  # components only grow, so later rounds have no other classes
            needed = open_rows.select("cid").distinct().withColumn("own", F.col("cid"))
            texts = _with_texts(needed, classes, docs, ["own"], "sketch").withColumnRenamed("own", "cid")
            sketches = written(texts.mapInArrow(_sketched(k), "cid binary, sketch binary").join(classes.select("cid", "n", "bands"), "cid"), "sketches")
        here = open_rows.filter(F.col("band").between(first, last - 1)).drop("band")
        more = _links_across(here, sketches, classes, docs, k, percent, f"cross-{step}")
        if more.limit(1).count():
            links = links.union(more)
            parts = connected_components(links, f"components-{step}").withColumnRenamed("node", "cid")
        freed(open_rows)
    freed(met, shared, sketches)
    linked = parts.join(classes.select("cid", "least_id"), "cid")
    least_of = linked.groupBy("component").agg(F.min("least_id").alias("component_id"))
    info = linked.join(least_of, "component").select("cid", "component_id", F.col("component").alias("group"))
    single = classes.filter("copies > 1").join(parts.select("cid"), "cid", "left_anti").select("cid", F.col("least_id").alias("component_id"), F.col("cid").alias("group"))
    info = written(info.unionByName(single), "components")
    freed(classes)
    out = rows.select("doc_id", "tk", "cid", "n_shingles").join(info.withColumn("grouped", F.lit(True)), "cid", "left")
    component = F.when(F.col("grouped"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "tk", F.coalesce("group", "cid").alias("group"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", seed: int = 3) -> DataFrame:
    """The rows of docs that stay when each group keeps the document with the least id; of repeated rows of it, one.

    Groups are told apart by their texts, so unrelated texts under null or repeated ids all stay. Rows without words link
    with nothing and all stay. All columns of docs come back as they are, whatever their names.
    """
    found = near_documents(docs, k, percent, id_col, text_col, seed).filter("group is not null")
    same = written(found.groupBy("group", *_row_key("doc_id", F.col("tk"))).agg(F.count("*").alias("rows")), "group-rows")
    firsts = same.groupBy("group").agg(F.min(F.struct("no", "d", "tk")).alias("first"), F.sum("rows").alias("members"))
    firsts = written(firsts.filter("members > 1").select("group", "first"), "groups")
    # Keys of the rows that go, and of those that are repeated as they stand: rows of neither kind meet nothing and don't travel far.
    judged = lookup_join(same, firsts, ["group"], "inner", spread=[F.col("tk")]).withColumn("goes", F.struct("no", "d", "tk") != F.col("first"))
    odd = written(judged.filter("goes or rows > 1").select("d", "no", "tk", "goes"), "odd-rows")
    freed(same, firsts)
    text = F.coalesce(F.col(f"row.{text_col}").cast("string"), F.lit(""))
    rows = packed(docs).withColumn("id", F.col(f"row.{id_col}").cast("long"))
    rows = rows.select("row", *_row_key("id", F.unhex(F.md5(text.cast("binary")))))
    key = ["d", "no", "tk"]
    marked = lookup_join(rows, odd, key)
    stay, repeated = marked.filter(F.col("goes").isNull()), marked.filter(~F.col("goes")).dropDuplicates(key)
    return stay.select("row").union(repeated.select("row")).select("row.*")
