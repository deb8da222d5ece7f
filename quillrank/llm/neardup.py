"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

Sketch: round r throws every shingle into a bin (a random one in the first COORDS rounds, bin r - COORDS after that)
with the value r + u, u uniform; a coordinate is the least value of its bin. Rounds stop once every bin is filled, which
the last COORDS rounds guarantee; in expectation this costs O(n + t log t) and each coordinate of two sets agrees with
the probability of their Jaccard similarity, with concentration like independent samples'.

Links: texts of equal shingle sets are one node, found by a 128-bit name of the set's 64-bit hashes; among n sets two
different ones share a name with probability n^2 / 2^129 (2e-15 for 10^12 sets), and within a pair of sets of a million
shingles a hash is shared by chance with probability 1e-7, so names aren't compared with texts again. The bands' buckets suggest pairs;
in each bucket all members are compared with its most central member first (the one that meets most others over its
buckets: of copies of one text, that text). After a pass over connected components only
members of one bucket that are still in different components remain, so a group of copies costs its size, not its
square. What the open buckets of one leader hold is a family; one of up to FAMILY_ROWS rows and FAMILY_BYTES of text is
compared within a task, where a pair whose components have met by then is left out. Of larger families a bucket of up to
FEW members has its remaining pairs compared by a join; a larger bucket holds texts that share a frequent passage but
little else: it is split by each later band, and so on, DEEPEST bands at most, where all that is left is compared. No
bucket is capped or sampled. Before texts are compared, a pair must agree in nearly as many sketch bits as the threshold
implies. Texts decide every
pair: full sets, integers only. A pair of similarity 0.75 agrees in 15 of 84 bands on average; it is missed if it agrees
in none (1e-7), if its bits deviate by five standard deviations (3e-7), or within buckets of more than FEW members in
fewer than DEEPEST bands (of 3: 1e-5, of 4: 8e-5) and no smaller bucket holds it.

Nulls and ties: a null or blank text has an empty set and links with nothing; rows that share a document id are one
document (its texts' links are joined); a row with a null id has its group's component, or null. Repeated rows come out
repeated. Empty tables give empty results; columns other than the two named ones are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillrank.llm._common import GOLD, byte_texts, map_arrow, mix, slices, words
from quillrank.runtime import discard, materialise, ship

SHINGLE, NUM, DEN = 5, 75, 100
BANDS, ROWS = 84, 6
COORDS = BANDS * ROWS  # 504: a bit of each makes 63 bytes
WORDS = -(-COORDS // 64)
#: Members of a bucket of which all pairs are compared, and bands that a split goes by at most.
FEW, DEEPEST = 2000, 4
#: Rows and bytes of text of a family that is compared within a task.
FAMILY_ROWS, FAMILY_BYTES = 4000, 16 << 20
#: Parts that the texts compared with one leader are dealt into.
SALTS = 64
_base = np.uint64(0x9E3779B97F4A7C15 | 1)


def shingle_set(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of size words; of all its words, if it has fewer."""
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words(text)), np.uint64)
    if not len(w):
        return w
    n = max(1, len(w) - size + 1)
    h = np.full(n, min(len(w), size), np.uint64)
    for k in range(min(len(w), size)):
        h = mix(h * _base + w[k : k + n])
    return np.unique(h)


def sketch(s: np.ndarray, t: int = COORDS) -> np.ndarray:
    """Fast similarity sketch of a non-empty set of 64-bit hashes: t coordinates."""
    out = np.full(t, np.iinfo(np.uint64).max, np.uint64)
    r, step = 0, max(1, int(np.ceil(t * np.log(t) / len(s))))
    while r < 2 * t:
        rounds = np.arange(r, min(2 * t, r + step), dtype=np.uint64)
        h = mix(s[None, :] + (rounds[:, None] + np.uint64(1)) * GOLD)
        own = rounds[:, None] < t
        bins = np.where(own, h % np.uint64(t), rounds[:, None] - np.minimum(rounds[:, None], np.uint64(t)))
        np.minimum.at(out, bins.ravel().astype(np.int64), ((rounds[:, None] << np.uint64(48)) | (h >> np.uint64(16))).ravel())
        r += len(rounds)
        if out.max() >> np.uint64(48) < r:
            break
        step *= 2
    return out


def band_keys(coords: np.ndarray, rows: int = ROWS) -> np.ndarray:
    x = coords.reshape(-1, rows)
    h = np.arange(len(x), dtype=np.uint64) + np.uint64(1)
    for k in range(rows):
        h = mix(h * _base + x[:, k])
    return h


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    return tuple(int(mix(s ^ np.uint64(k)).sum(dtype=np.uint64).astype(np.int64)) for k in (0x5BD1E995, 0x1B873593))


def sketches(df: DataFrame, id_col: str, text_col: str, size: int = SHINGLE) -> DataFrame:
    """Per row: id, n (set size), k1, k2 (set's name), bands (array<bigint>, empty for an empty set), bits (array<bigint>:
    the lowest bit of each coordinate)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                n, k1, k2, bands, bits = [], [], [], [], []
                for t in byte_texts(part.column(1)):
                    s = shingle_set(t, size)
                    a, b = set_key(s) if len(s) else (0, 0)
                    n.append(len(s))
                    k1.append(a)
                    k2.append(b)
                    coords = sketch(s) if len(s) else None
                    bands.append(band_keys(coords).astype(np.int64) if len(s) else ())
                    bits.append(np.packbits(np.pad(coords & np.uint64(1), (0, 64 * WORDS - COORDS)).astype(np.uint8)).view(np.int64) if len(s) else (0,) * WORDS)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))], names=["id", "n", "k1", "k2", "bands", "bits"])

    kind = dict(df.dtypes)[id_col]
    return map_arrow(df.select(id_col, text_col), run, f"id {kind}, n bigint, k1 bigint, k2 bigint, bands array<bigint>, bits array<bigint>")


def similar(a: np.ndarray, b: np.ndarray, num: int = NUM, den: int = DEN) -> bool:
    """den * intersection >= num * union, in integers."""
    if not len(a) or not len(b) or den * min(len(a), len(b)) < num * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (len(a) + len(b) - both)


def likely(a: str, b: str, num: int, den: int) -> Column:
    """Whether two sketches differ in allowed() bits at most."""
    differ = sum((F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(1, WORDS)), F.bit_count(F.col(a)[0].bitwiseXOR(F.col(b)[0])))
    return differ <= allowed(num, den)


def verified(pairs: DataFrame, texts: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose texts' full sets are similar. A leader a with many partners is dealt into SALTS parts."""
    salt = F.pmod(F.xxhash64("b"), F.lit(SALTS))
    right = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").withColumn("salt", salt)
    left = pairs.select("a", salt.alias("salt")).distinct().join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(right, ["a", "salt"]).select("a", "b", "text_a", "text_b")

    def run(batches):
        last, own = None, None
        for batch in batches:
            for part in slices(batch, 2, 3):
                keep = []
                for x, y in zip(byte_texts(part.column(2)), byte_texts(part.column(3)), strict=True):
                    if x != last:
                        last, own = x, shingle_set(x, size)
                    keep.append(similar(own, shingle_set(y, size), num, den))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(keep))

    kind = dict(pairs.dtypes)["a"]
    return map_arrow(both, run, f"a {kind}, b {kind}").distinct()


def allowed(num: int, den: int) -> int:
    """Bits of two sketches that may differ: as many as a pair at the threshold has but for five standard deviations (a
    chance of 3e-7); a coordinate's bits agree with probability (1 + similarity) / 2."""
    p = (1 + num / den) / 2
    return COORDS - int(COORDS * p - 5 * (COORDS * p * (1 - p)) ** 0.5)


def family_links(rows: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """rows: lead, id, label, bits, text, of leads with at most FAMILY_ROWS rows and FAMILY_BYTES of text. Links a, b
    between rows of one lead that join different labels, found by full sets; a pair whose labels are joined by then is
    left out, so a family gives fewer links than it has rows."""
    most = allowed(num, den)

    def link(table: pa.Table) -> pa.Table:
        ids, up = table["id"].to_pylist(), {}
        label = table["label"].to_pylist()

        def root(x):
            while (y := up.get(x, x)) != x:
                up[x] = x = up.get(y, y)
            return x

        bits = np.array(table["bits"].to_pylist(), np.int64).view(np.uint64).reshape(len(ids), -1)
        held: list = [None] * len(ids)
        texts = byte_texts(table["text"].combine_chunks())

        def of(i):
            if held[i] is None:
                held[i] = shingle_set(texts[i], size)
            return held[i]

        a, b = [], []
        for i in range(len(ids) - 1):
            differ = np.bitwise_count(bits[i + 1 :] ^ bits[i]).sum(1)
            near = np.flatnonzero(differ <= most)
            for j in (near[np.argsort(differ[near], kind="stable")] + i + 1).tolist():
                x, y = root(label[i]), root(label[j])
                if x != y and similar(of(i), of(j), num, den):
                    up[max(x, y)] = min(x, y)
                    a.append(min(ids[i], ids[j]))
                    b.append(max(ids[i], ids[j]))
        return pa.table({"a": pa.array(a, table.schema.field("id").type), "b": pa.array(b, table.schema.field("id").type)})

    kind = dict(rows.dtypes)["id"]
    ship(rows.sparkSession)
    return rows.groupBy("lead").applyInArrow(link, f"a {kind}, b {kind}").distinct()


def components(edges: DataFrame) -> DataFrame:
    """id and label (the least id reachable) of every end of the edges (a, b): least labels of neighbours, then the
    labels' own labels, until nothing changes. Every step is written to the shared folder."""
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("id").alias("next"), F.col("label").alias("far"))
        new = materialise(step.join(jump, "next", "left").select("id", F.col("label").alias("old"), F.least("next", F.coalesce("far", "next")).alias("label")), "labels")
        discard(labels)
        if new.filter("old <> label").isEmpty():
            discard(both)
            return new.select("id", "label")
        labels = new


def with_nodes(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """rows (id, n, k1, k2) with the node of their set; null for an empty set, or if no row with an id has it. Sets of many
    copies, of which there are few, are looked up by name and salt first; what is left of the rows is dealt by name, but
    those that need no name by their id, so no name's rows meet in one task."""
    salts = F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))
    wide = sets.filter(F.col("copies") > FEW).select("k1", "k2", F.col("node").alias("wide"), F.explode(salts).alias("salt"))
    first = rows.withColumn("salt", F.pmod(F.xxhash64("id", "n"), F.lit(SALTS))).join(wide, ["k1", "k2", "salt"], "left")
    need = F.col("wide").isNull() & (F.col("n") > 0)
    first = first.select("id", "n", "wide", need.alias("need"), F.when(need, F.col("k1")).otherwise(F.xxhash64("id")).alias("j1"), F.when(need, F.col("k2")).otherwise(F.col("salt")).alias("j2"))
    rest = sets.filter(F.col("copies") <= FEW).select(F.lit(True).alias("need"), F.col("k1").alias("j1"), F.col("k2").alias("j2"), "node")
    return first.join(rest, ["need", "j1", "j2"], "left").select("id", "n", F.coalesce("wide", "node").alias("node"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """Per row: id_col, n_shingles, component_id (least id reachable over links with den * intersection >= num * union),
    kept (id is the component's)."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = materialise(sketches(own, "id", "text", size), "sketches")
    named = rows.filter("n > 0 and id is not null")
    # equal sets are one node: its least id
    sets = materialise(named.groupBy("k1", "k2").agg(F.min("id").alias("node"), F.count("*").alias("copies")), "sets")
    keyed = named.groupBy("k1", "k2").agg(F.min("id").alias("node"), F.first("bands").alias("bands"))
    level = keyed.select("node", F.posexplode("bands").alias("band", "key"))
    sizes = named.select("id", "n", "bits")
    # rows of one id but several texts: its texts' nodes belong together
    several = named.groupBy("id").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi"), F.min("k2").alias("lo2"), F.max("k2").alias("hi2")).filter("lo <> hi or lo2 <> hi2").select("id")
    shared = with_nodes(named.join(several, "id", "left_semi").select("id", "n", "k1", "k2"), sets).filter("id <> node")
    edges = materialise(shared.select(F.col("node").alias("a"), F.col("id").alias("b")).distinct(), "links")
    fits = lambda m, n: F.lit(den) * F.least(m, n) >= F.lit(num) * F.greatest(m, n)  # noqa: E731  no link is possible otherwise
    texts, tried, labels = None, None, edges.select(F.col("a").alias("id"), F.col("a").alias("label")).limit(0)
    for depth in range(1, DEEPEST + 1):
        # all members of a bucket against its most central one: that which meets most others over all its buckets
        counts = level.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
        met = materialise(level.join(counts, "key"), "met")
        central = met.groupBy("node").agg(F.sum("members").alias("central"))
        leads = met.select("key", "node").join(central, "node").groupBy("key").agg(F.min(F.struct(-F.col("central"), "node")).alias("first"))
        members = materialise(met.join(leads, "key").select("key", "band", F.col("node").alias("id"), F.col("first.node").alias("lead"), "members"), "members")
        if texts is None:
            ids = members.select("id").distinct()
            texts = materialise(own.join(ids, "id", "left_semi"), "texts")
            sizes = materialise(sizes.join(ids, "id", "left_semi"), "bits")
        ends = [sizes.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")) for c in "ab"]
        star = members.filter("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
        star = star if tried is None else star.join(tried, ["a", "b"], "left_anti")
        star = materialise(star.join(ends[0], "a").join(ends[1], "b").filter(fits(F.col("n_a"), F.col("n_b")) & likely("bits_a", "bits_b", num, den)).select("a", "b").distinct(), "pairs")
        edges = edges.union(materialise(verified(star, texts, size, num, den), "links"))
        tried = star if tried is None else tried.union(star)
        labels = components(edges)
        # what a bucket still holds in different components: all such pairs of a small one, a large one is split
        at = members.join(labels, "id", "left").select("key", "band", "id", "lead", "members", F.coalesce("label", "id").alias("label"))
        open_keys = at.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key")
        rest = materialise(at.join(open_keys, "key", "left_semi"), "rest")
        few = rest if depth == DEEPEST else rest.filter(F.col("members") <= FEW)
        # families: what the open buckets of one leader hold. One of bounded size is compared within a task. The larger
        # ones, of which there are few, are looked up by leader and salt, so none of their rows meet in one task
        salted = few.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
        bytes_of = texts.select("id", F.octet_length("text").alias("bytes"))
        family = materialise(salted.select("lead", "salt", "id", "label").distinct().join(bytes_of, "id"), "families")
        wide = family.groupBy("lead").agg(F.count("*").alias("rows"), F.sum("bytes").alias("bytes")).filter((F.col("rows") > FAMILY_ROWS) | (F.col("bytes") > FAMILY_BYTES))
        wide = wide.select("lead", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt"))
        together = family.join(wide, ["lead", "salt"], "left_anti").join(sizes, "id").join(texts, "id").select("lead", "id", "label", "bits", "text")
        near = materialise(family_links(together, size, num, den), "links")
        few = salted.join(wide, ["lead", "salt"], "left_semi").select("key", "id", "label").join(sizes, "id")
        x, y = (few.select("key", F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("label").alias(f"label_{c}"), F.col("bits").alias(f"bits_{c}")) for c in "ab")
        apart = (F.col("label_a") < F.col("label_b")) & fits(F.col("n_a"), F.col("n_b")) & likely("bits_a", "bits_b", num, den)
        cross = x.join(y, (x["key"] == y["key"]) & apart).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        cross = materialise(cross.join(tried, ["a", "b"], "left_anti"), "pairs")
        if not cross.isEmpty():
            tried = tried.union(cross)
            near = near.union(materialise(verified(cross, texts, size, num, den), "links"))
        if not near.isEmpty():
            edges = edges.union(near)
            labels = components(edges)
        many = rest.filter(F.col("members") > FEW)
        if depth == DEEPEST or many.isEmpty():
            break
        deeper = many.join(rows.select("id", "bands"), "id").select(F.col("id").alias("node"), F.col("key").alias("up"), F.col("band").alias("from"), F.posexplode("bands").alias("band", "own"))
        level = deeper.filter("band > from").select("node", "band", F.xxhash64("up", "own").alias("key")).distinct()
    labelled = sets.join(labels.withColumnRenamed("id", "node"), "node", "left").select("k1", "k2", "copies", F.coalesce("label", "node").alias("node"))
    found = with_nodes(rows.select("id", "n", "k1", "k2"), labelled)
    component: Column = F.when((F.col("n") > 0) & F.col("node").isNotNull(), F.col("node")).otherwise(F.col("id"))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def keyed_ids(df: DataFrame, id_col: str, text_col: str) -> Column:
    """Text keys in the order of the ids (whole numbers by value, others as text); after them, rows without an id by a
    hash of their text."""
    own = F.col(id_col)
    if dict(df.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint"):
        named = F.lpad(F.hex(own.cast("bigint").bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    else:
        named = own.cast("string")
    return F.when(own.isNotNull(), F.concat(F.lit("0"), named)).otherwise(F.concat(F.lit("1"), F.sha2(F.col(text_col), 256)))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose document represents its group, all columns as they are; of rows that share an id, one. A row
    with a null id is a document of its own, which represents its group if none with an id is in it; equal texts are one
    group, and a blank text has none, so its row stays."""
    if not docs.filter(F.col(id_col).isNull()).isEmpty():
        blank = F.col(id_col).isNull() & ~F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^ \t\n\x0B\f\r]")
        key = "_key"
        while key in docs.columns:
            key += "_"
        rest = docs.filter(~blank)
        whole = deduplicated(rest.withColumn(key, keyed_ids(rest, id_col, text_col)), key, text_col)
        return whole.drop(key).union(docs.filter(blank))
    found = near_duplicates(docs, id_col, text_col)
    kept = materialise(found.filter("kept").groupBy(id_col).agg(F.count("*").alias("_rows")), "kept")
    k = kept.select(F.col(id_col).alias("_k"))
    out = docs.join(k, docs[id_col].eqNullSafe(F.col("_k")), "left_semi")
    if kept.filter("_rows > 1").isEmpty():
        return out
    # of rows that share an id the one with the least text (then the least of all columns), whichever task is repeated
    again = kept.filter("_rows > 1").select(F.col(id_col).alias("_k"))
    order = [text_col, *(c for c in docs.columns if c not in (text_col, id_col))]
    first = F.row_number().over(W.partitionBy(id_col).orderBy(*[F.col(c).asc_nulls_first() for c in order]))
    at = "_at"
    while at in docs.columns:
        at += "_"
    least = out.join(again, out[id_col] == F.col("_k"), "left_semi").withColumn(at, first).filter(F.col(at) == 1).drop(at)
    return out.join(again, out[id_col] == F.col("_k"), "left_anti").union(least)
