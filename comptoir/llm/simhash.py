"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every fingerprint stands for all variants within half the radius; two fingerprints within the radius
share a variant. Variants with the same leading bits go to the same group, so what is shuffled is one
record for each fingerprint and group, and a group expands, sorts and compares its variants in blocks
of bounded size. Groups above a size are spread again on their next bits, down to single variants if
need be: at most 2,081 fingerprints of 64 bits lie within two bits of one, so no group stays large.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations
from math import acos, ceil, comb, log, pi, sqrt

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comptoir.llm.shared import appended, checkpointed, table, written
from comptoir.operators.components import connected_components

#: Shingles hashed at once, variants compared at once, records in a group before it is spread again.
BLOCK, VARIANTS, GROUP = 1 << 15, 1 << 20, 1 << 17
#: Members up to which all pairs of a run are compared at once.
SHORT = 32


def shingle_hashes(text: str, words: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles of a text, in blocks; words are runs of bytes other than ASCII white space, A-Z in lower case."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return
    line, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        yield np.array([digest(line, seed)], dtype=np.uint64)
        return
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    starts, ends = starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist()
    for i in range(0, len(starts), BLOCK):
        yield np.array([digest(line[a:b], seed) for a, b in zip(starts[i : i + BLOCK], ends[i : i + BLOCK], strict=True)], dtype=np.uint64)


def _signs(h: np.ndarray, lane: int) -> np.ndarray:
    """64 sums of bits over hashes; lanes after the first mix the same hash anew."""
    x = h
    if lane:  # the finaliser of SplitMix64 on h + lane * its increment
        x = h + np.uint64((0x9E3779B97F4A7C15 * lane) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.unpackbits(x.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)


def sketch(blocks: Iterable[np.ndarray], lanes: int = 1) -> np.ndarray:
    """lanes x 64 majority bits over blocks of hashes; zeros without any."""
    n, votes = 0, np.zeros((lanes, 64), np.int64)
    for h in blocks:
        n += len(h)
        for lane in range(lanes):
            votes[lane] += _signs(h, lane)
    return np.packbits(votes * 2 > n, axis=1, bitorder="little").view("<u8").ravel()


def with_sketch(docs: DataFrame, text: str = "text", words: int = 4, seed: int = 42) -> DataFrame:
    """docs without the text, with s0 (long): the sketch over its shingles, repeats included. Null and blank texts give zero."""
    one = lambda t: sketch(shingle_hashes(t or "", words, seed)).view(np.int64)[0]
    return appended(docs, text, {"s0": "long"}, lambda: lambda texts: [np.array([one(t) for t in texts], np.int64)], drop=True)


def merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of a[i] and b[i]; labels point to the smallest member known."""
    while len(a):
        la, lb = labels[a], labels[b]
        open_ = la != lb
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(up := labels[labels], labels):
            labels[:] = up


def ball(left: int, width: int) -> int:
    return sum(comb(width, i) for i in range(left + 1))


def flips(left: int, width: int) -> list[np.ndarray]:
    """For each weight up to left, the words of width bits of that weight."""
    return [np.array([sum(1 << i for i in c) for c in combinations(range(width), w)], dtype=np.uint64) for w in range(left + 1)]


def collide(key: np.ndarray, left: np.ndarray, width: int, use, own: np.ndarray | None = None) -> None:
    """Calls use(runs, owners) with the entries that share their variant with others; those of a run stand together.

    key: the fingerprints, whose bits above width are settled; left: the flips that each may still make.
    """
    own = np.arange(len(key)) if own is None else own
    if len(key) < 2:
        return
    sizes = np.bincount(left)
    if width > 0 and sum(int(n) * ball(r, width) for r, n in enumerate(sizes)) > VARIANTS:
        step = min(4, width)
        chunk = (key >> np.uint64(width - step)) & np.uint64((1 << step) - 1)
        for q in range(1 << step):
            off = np.bitwise_count(chunk ^ np.uint64(q)).astype(np.int64)
            if (near := off <= left).any():
                collide(key[near], left[near] - off[near], width - step, use, own[near])
        return
    low = key & np.uint64((1 << width) - 1)
    made, owners = [], []
    for w, masks in enumerate(flips(len(sizes) - 1, width)):
        able = left >= w
        made.append((low[able][:, None] ^ masks).ravel())
        owners.append(np.repeat(own[able], len(masks)))
    made, owners = np.concatenate(made), np.concatenate(owners)
    order = np.argsort(made)
    made, owners = made[order], owners[order]
    same = made[1:] == made[:-1]
    shared = np.concatenate((same, [False])) | np.concatenate(([False], same))
    runs = np.cumsum(np.concatenate(([True], ~same)))
    use(runs[shared], owners[shared])


def join_runs(runs: np.ndarray, owners: np.ndarray, labels: np.ndarray, near) -> None:
    """Joins the labels of all pairs of a run for which near(a, b) holds; pairs that are joined already are not compared."""

    def joined(a: np.ndarray, b: np.ndarray) -> None:
        apart = labels[a] != labels[b]
        a, b = a[apart], b[apart]
        if len(a):
            fit = near(a, b)
            merge(labels, a[fit], b[fit])

    begin = np.concatenate(([0], np.flatnonzero(np.diff(runs)) + 1)) if len(runs) else np.zeros(0, np.int64)
    size = np.diff(begin, append=len(runs))
    small = np.repeat(size <= SHORT, size)
    for d in range(1, SHORT):
        at = np.flatnonzero((runs[d:] == runs[:-d]) & small[d:])
        if not len(at):
            break
        joined(owners[at], owners[at + d])
    for i in np.flatnonzero(size > SHORT):
        own = np.unique(owners[begin[i] : begin[i] + size[i]])
        for a in own[:SHORT]:
            joined(np.full(len(own), a), own)
        names, counts = np.unique(labels[own], return_counts=True)
        for a in own[labels[own] != names[np.argmax(counts)]]:  # two ends that stay apart are not both in the largest set
            joined(np.full(len(own), a), own)


def _spread(rows: DataFrame, step: int, half: int, bits: int) -> DataFrame:
    """Each record once for every value that its next bits can take with the flips left."""
    masks = [(int(m), w) for w, ms in enumerate(flips(min(half, step), step)) for m in ms]
    each = F.explode(F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(w).alias("w")) for m, w in masks])).alias("f")
    shift = F.lit(bits) - F.col("depth").cast("int") - step
    chunk = F.call_function("shiftrightunsigned", F.col("key"), shift.cast("int")).bitwiseAND(F.lit((1 << step) - 1))
    return (
        rows.select("*", each)
        .where("f.w <= left")
        .withColumns({"path": F.shiftleft("path", step).bitwiseOR(chunk.bitwiseXOR(F.col("f.m"))), "left": (F.col("left") - F.col("f.w")).cast("byte"), "depth": (F.col("depth") + step).cast("byte")})
        .drop("f")
    )


def _key(first: int, bits: int) -> Column:
    """`bits` bits of the sketch from bit `first` on."""
    lane, off = divmod(first, 64)
    got = F.call_function("shiftrightunsigned", F.col(f"s{lane}"), F.lit(off))
    if off + bits > 64:
        got = got.bitwiseOR(F.shiftleft(f"s{lane + 1}", 64 - off))
    return got.bitwiseAND(F.lit((1 << bits) - 1 if bits < 64 else -1))


def ball_links(sketches: DataFrame, checked: int, tables: int, bits: int, radius: int, most: int, group: int = GROUP, least: int = 8) -> DataFrame:
    """Links (a, b) of rows of sketches (node long, s0..), at most a tree for each group of records.

    Each table takes the next `bits` bits of the sketch. Nodes that share a variant within radius // 2
    flips in a table are linked if they differ in at most `most` bits of the first `checked` lanes, all
    members of a variant being compared or joined already. More than `group` nodes with the very same variant are
    linked to the smallest of them unchecked, without meeting in a task: only many copies of one text come to that.
    """
    half, names = radius // 2, [f"s{i}" for i in range(checked)]
    n = max(2, sketches.count())
    each = F.array(*[F.struct(F.lit(t).cast("byte").alias("t"), _key(t * bits, bits).alias("key")) for t in range(tables)])
    rows = sketches.select("node", *names, F.explode(each).alias("of")).select("node", *names, "of.t", "of.key")
    step = next((k for k in range(least, bits) if n * ball(half, k) / 2**k <= group / 2), bits)
    rows = rows.withColumns({"left": F.lit(half).cast("byte"), "path": F.lit(0).cast("long"), "depth": F.lit(0).cast("byte")})
    rows, depth, calm, stars = _spread(rows, step, half, bits), step, [], None
    while True:
        hot = checkpointed(rows.groupBy("t", "path").agg(F.count("*").alias("n"), F.min("node").alias("low")).where(F.col("n") > group))
        if hot.isEmpty():
            break
        calm.append(rows.join(hot, ["t", "path"], "left_anti"))
        rows = rows.join(hot.select("t", "path", "low"), ["t", "path"])
        if depth == bits:
            stars = rows.select(F.col("low").alias("a"), F.col("node").alias("b")).where("a != b")
            rows = rows.where("false").drop("low")
            break
        step = min(8, bits - depth)
        rows, depth = _spread(rows.drop("low"), step, half, bits), depth + step
    for more in calm:
        rows = rows.unionByName(more)

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", ignore_index=True)
        nodes, whole = pdf["node"].to_numpy(), pdf[names].to_numpy(np.int64).view(np.uint64)
        labels = np.arange(len(pdf))

        def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return np.bitwise_count(whole[a] ^ whole[b]).sum(axis=1, dtype=np.int64) <= most

        collide(pdf["key"].to_numpy(np.int64).view(np.uint64), pdf["left"].to_numpy(np.int64), bits - int(pdf["depth"].iloc[0]), lambda runs, owners: join_runs(runs, owners, labels, near))
        linked = np.flatnonzero(labels != np.arange(len(pdf)))
        return pd.DataFrame({"a": nodes[labels[linked]], "b": nodes[linked]})

    out = rows.groupBy("t", "depth", "path").applyInPandas(links, "a long, b long")
    return out if stars is None else out.unionByName(stars)


def _told(rows: DataFrame, known: DataFrame, key: str, share: int = 1024) -> DataFrame:
    """rows joined with known (key, n, ...; one row for each key, n rows of `rows` hold it), without n.

    Keys that hold a 1/`share` of all rows or more are at most `share`, so those are broadcast, and no
    task of the shuffled join gets more than such a share of one key.
    """
    total = rows.count()
    hot = F.col("n") * share >= total
    few = checkpointed(known.where(hot).drop("n"))
    rest = rows.join(F.broadcast(few.select(key)), key, "left_anti").join(known.where(~hot).drop("n"), key)
    return rest.unionByName(rows.join(F.broadcast(few), key))


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, seed: int = 42, radius: int = 4, group: int = GROUP) -> DataFrame:
    """Rows (doc_id, fp, component_id), one for each row of docs.

    fp: the 64-bit fingerprint as a long; fingerprints at `radius` or fewer differing bits link, and
    component_id is the smallest doc_id reachable. Null, empty and blank texts have fingerprint zero, linked
    like any other. Repeated rows stay. A null doc_id has the component of its text's group (null if no
    document there has an id). An empty table gives no rows. Other columns are dropped.
    """
    prints = checkpointed(with_sketch(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", words, seed).withColumnRenamed("s0", "fp"))
    first = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    links = ball_links(first.select(F.col("fp").alias("node"), F.col("fp").alias("s0")), 1, 1, 64, radius, radius, group)
    members = connected_components(links).withColumnRenamed("node", "fp")
    lowest = members.join(first, "fp").groupBy("component").agg(F.min("first").alias("lowest"))
    lowest = members.join(lowest, "component").select("fp", "lowest")
    whole = first.join(lowest, "fp", "left").select("fp", "n", F.coalesce("lowest", "first").alias("component_id"))
    return _told(prints, whole, "fp").select("doc_id", "fp", "component_id")


#: Near-duplicate stage: shingles of five words; radius of its tables; recall at the similarity asked for; chance neighbours of a document in a table at most; bytes of shingle sets in a task; documents of a family that all its tasks see.
STAGE_WORDS, STAGE_RADIUS, RECALL, CHANCE, TASK_BYTES, PIVOTS = 5, 2, 0.99, 64, 1 << 24, 64
#: Records in a group of the stage, which holds smaller ones; sketches of a family's part that meet those of another.
STAGE_GROUP, SKETCHES = 1 << 20, 4096
#: Partitions of its comparisons at most.
MOST_PARTS = 1 << 13


def shingle_set(text: str | None, words: int = STAGE_WORDS, seed: int = 42) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending; none for null and blank texts."""
    blocks = list(shingle_hashes(text or "", words, seed))
    return np.unique(np.concatenate(blocks)) if blocks else np.zeros(0, np.uint64)


def differing(similarity: float) -> float:
    """The share of sketch bits in which sets of this Jaccard similarity differ; a hundredth more, for short texts and sets of unlike size."""
    return acos(2 * similarity / (1 + similarity)) / pi + 0.01


def at_most(bits: int, similarity: float) -> int:
    """Differing bits out of `bits` that sets of this similarity stay within, but for a few in a million."""
    p = differing(similarity)
    return ceil(bits * p + 4.5 * sqrt(bits * p * (1 - p)))


def table_plan(n: int, similarity: float, radius: int = STAGE_RADIUS, recall: float = RECALL, chance: float = CHANCE) -> tuple[int, int]:
    """(tables, bits of each) for n sketches: bits so that unlike ones rarely meet, tables so that a pair at `similarity` meets in one with probability `recall`, at every n."""
    p = differing(similarity)
    bits = next((b for b in range(12, 64) if n * ball(radius, b) / 2**b <= chance), 64)
    meets = sum(comb(bits, i) * p**i * (1 - p) ** (bits - i) for i in range(radius + 1))
    return max(1, ceil(log(1 - recall) / log(1 - meets))), bits


def _likeness(sets: list[np.ndarray], sizes: np.ndarray, i: int, js: np.ndarray) -> np.ndarray:
    """The Jaccard similarities of set i and each of sets js, in blocks of about BLOCK hashes; 1 for two empty sets."""
    out, at, ends = np.ones(len(js)), 0, np.cumsum(sizes[js])
    while at < len(js) and sizes[i]:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, side="right")))
        block, n = np.concatenate([sets[j] for j in js[at:to]]), sizes[js[at:to]]
        found = sets[i][np.minimum(np.searchsorted(sets[i], block), sizes[i] - 1)] == block
        total = np.concatenate(([0], np.cumsum(found)))
        both = total[np.cumsum(n)] - total[np.cumsum(n) - n]
        out[at:to] = both / (sizes[i] + n - both)
        at = to
    return out


def alike(pdf: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Links (a, b) that join the rows (node, label, packed, s0..; packed is the text, compressed) of this exact Jaccard similarity or more; pairs that links or equal labels join already, or whose sketches lie too far apart, are not compared."""
    pdf = pdf.sort_values("node", ignore_index=True)
    nodes, lanes = pdf["node"].to_numpy(), pdf[[c for c in pdf.columns if c[0] == "s" and c[1:].isdigit()]].to_numpy(np.int64).view(np.uint64)
    most = at_most(64 * lanes.shape[1], similarity)
    open_ = zstandard.ZstdDecompressor().decompress
    sets = [shingle_set(open_(bytes(t)).decode("utf-8", "surrogatepass")) for t in pdf["packed"]]
    sizes, labels = np.array([len(x) for x in sets]), np.unique(pdf["label"].to_numpy(), return_inverse=True)[1]
    a, b = [], []
    for i in range(len(nodes) - 1):
        js = np.flatnonzero(labels[i + 1 :] != labels[i]) + i + 1
        js = js[np.minimum(sizes[js], sizes[i]) >= similarity * np.maximum(sizes[js], sizes[i]) - 1e-9]
        js = js[np.bitwise_count(lanes[js] ^ lanes[i]).sum(axis=1, dtype=np.int64) <= most]
        fits = js[_likeness(sets, sizes, i, js) >= similarity - 1e-9]
        joined = {}
        for j in fits.tolist():
            joined.setdefault(labels[j], nodes[j])
        a += [nodes[i]] * len(joined)
        b += joined.values()
        if joined:
            labels[np.isin(labels, list(joined))] = labels[i]
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def _parts(rows: DataFrame, wanted: float) -> int:
    """Partitions for work that grows faster than its bytes: Spark would put small ones together by their bytes alone."""
    return int(min(MOST_PARTS, max(wanted, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))))


def _compared(rows: DataFrame, tasks: list[str], similarity: float, wanted: float) -> DataFrame:
    run = lambda pdf: alike(pdf, similarity)
    return rows.repartition(_parts(rows, wanted), *tasks).groupBy(*tasks).applyInPandas(run, "a long, b long")


def apart(pdf: pd.DataFrame, most: int, block: int = 512) -> pd.DataFrame:
    """Nodes of rows (node, label, spot, s0..) whose sketch lies within `most` bits of one with another label in another spot (in the same one, if there is one alone); blocks of rows at a time."""
    nodes, labels, parts = pdf["node"].to_numpy(), pdf["label"].to_numpy(), pdf["spot"].to_numpy()
    lanes = pdf[[c for c in pdf.columns if c[0] == "s" and c[1:].isdigit()]].to_numpy(np.int64).view(np.uint64)
    both = len(np.unique(parts)) > 1
    near = np.zeros(len(nodes), bool)
    for i in range(0, len(nodes), block):
        away = np.zeros((min(block, len(nodes) - i), len(nodes)), np.uint16)
        for lane in lanes.T:
            away += np.bitwise_count(lane[i : i + block, None] ^ lane[None])
        fits = (away <= most) & (labels[i : i + block, None] != labels[None])
        if both:
            fits &= parts[i : i + block, None] != parts[None]
        near[i : i + block] |= fits.any(axis=1)
    return pd.DataFrame({"node": nodes[near]})


def _met(member: DataFrame) -> DataFrame:
    """Members (family, label, weight, ...) of families dealt into p parts of the largest label and q of the rest, once for each pair (i, j) of parts in which one is of the rest; families of one label alone are left out. weight: as a share of a task."""
    weight = member.groupBy("family", "label").agg(F.sum("weight").alias("weight"))
    main = weight.groupBy("family").agg(F.max_by("label", F.struct("weight", "label")).alias("main"), F.max("weight").alias("most"), F.sum("weight").alias("all"))
    main = main.select("family", "main", F.ceil("most").cast("int").alias("p"), F.ceil(F.col("all") - F.col("most")).cast("int").alias("q")).where("q > 0")
    member = member.join(main, "family")
    spot = F.when(F.col("label") == F.col("main"), F.pmod(F.xxhash64("node"), "p")).otherwise(F.col("p") + F.pmod(F.xxhash64("node"), "q")).cast("int")
    member = member.withColumn("spot", spot)
    # parts from p on hold the rest; they meet all parts, those before p never meet each other
    met = F.sequence(F.when(F.col("spot") < F.col("p"), F.col("p")).otherwise(F.lit(0)), F.col("p") + F.col("q") - 1)
    pairs = F.transform(met, lambda j: F.struct(F.least("spot", j).alias("i"), F.greatest("spot", j).alias("j")))
    return member.withColumn("pair", F.explode(pairs)).drop("weight", "main", "p", "q")


def near_links(sets: DataFrame, texts: DataFrame, families: DataFrame, similarity: float = 0.8, task: int = TASK_BYTES) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of one family at this exact Jaccard similarity or more.

    sets: (node, row, size, s0..); texts: (row, packed, s0..); families: (node, family). A family of more than
    `task` bytes is dealt into parts that meet some of its documents each. Then all of it but its largest
    component meets the whole family, in pairs of parts: first the sketches alone, which tell the documents
    that may be like one not joined with them by then, and of those the texts, so that every such pair is compared.
    """
    names = [c for c in sets.columns if c[0] == "s" and c[1:].isdigit()]
    member = checkpointed(sets.select("node", "row", (2 * F.col("size") + 64).alias("bytes"), *names).join(families, "node"))
    large = F.ceil(F.sum("bytes") / F.lit(task)).cast("int")
    sizes = member.groupBy("family").agg(large.alias("parts"), F.count("*").alias("n"))
    dealt = member.join(sizes, "family")
    own = F.pmod(F.xxhash64("node"), "parts").cast("int")
    pivot = (F.col("parts") > 1) & (F.pmod(F.xxhash64("node", F.lit(1)), "n") < PIVOTS)
    dealt = dealt.select("node", "row", "family", F.explode(F.when(pivot, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own))).alias("part"))
    total = member.agg(F.sum("bytes")).first()[0] or 0
    links = checkpointed(_compared(dealt.withColumn("label", F.col("node")).join(texts, "row"), ["family", "part"], similarity, 4 * total / task))
    hot = checkpointed(sizes.where("parts > 1").select("family"))
    if hot.isEmpty():
        return links
    known = connected_components(links)
    member = member.join(hot, "family").join(known, "node", "left").withColumn("label", F.coalesce("component", "node"))
    member = checkpointed(member)
    most, blocks = at_most(64 * len(names), similarity), member.count() / SKETCHES
    sketches = _met(member.select("node", "family", "label", F.lit(1 / SKETCHES).alias("weight"), *names)).select("node", "family", "label", "spot", *names, "pair.i", "pair.j")
    sketches = sketches.repartition(_parts(sketches, blocks**2), "family", "i", "j")
    open_ = checkpointed(sketches.groupBy("family", "i", "j").applyInPandas(lambda pdf: apart(pdf, most), "node long").distinct())
    left = checkpointed(member.join(open_, "node").select("node", "row", "family", "label", (F.col("bytes") / F.lit(task)).alias("weight")))
    shares = left.agg(F.sum("weight")).first()[0] or 0
    return links.unionByName(_compared(_met(left).select("node", "row", "family", "label", "pair.i", "pair.j").join(texts, "row"), ["family", "i", "j"], similarity, (shares + 1) ** 2))


def near_duplicate_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = 0.8, task: int = TASK_BYTES, recall: float = RECALL, group: int = STAGE_GROUP) -> DataFrame:
    """Rows (doc_id, first) for every row of docs: first is the smallest doc_id of its group of near copies.

    Ball hashing of the sketches of the sets of five-word shingles gives families of candidates, and the exact
    Jaccard similarity of those sets decides within a family: `similarity` or more makes near copies. A pair at just that
    similarity meets with probability `recall`, more above. Blank texts are copies of one another; repeated
    rows and null ids stay as rows, and a null id names no group unless all its ids are null. Other columns are dropped.
    """
    tables, bits = table_plan(max(2, docs.count()), similarity, recall=recall)
    lanes = max(2, -(-tables * bits // 64))
    names = [f"s{i}" for i in range(lanes)]

    def sketched(texts: list[str | None]) -> list:
        sets, raw, squeeze = [shingle_set(t) for t in texts], [(t or "").encode("utf-8", "surrogatepass") for t in texts], zstandard.ZstdCompressor().compress
        nodes = np.array([xxhash.xxh64_intdigest(x.astype("<u8").tobytes()) for x in sets], np.uint64).view(np.int64)
        got = np.array([sketch([x], lanes).view(np.int64) for x in sets], np.int64).reshape(-1, lanes)
        return [list(map(len, raw)), list(map(squeeze, raw)), nodes, *np.ascontiguousarray(got.T)]

    ids = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    prints = written(appended(ids, "text", {"size": "long", "packed": "binary"} | {c: "long" for c in ["node", *names]}, lambda: sketched, drop=True), "shingles")
    at = F.struct("row", "size", *names)
    first = checkpointed(prints.groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"), F.min_by(at, "row").alias("at")))
    # all lanes decide what links a family: with few of them unlike documents chain to one that grows faster than the table
    near = ball_links(first.select("node", *[f"at.{c}" for c in names]), lanes, tables, bits, STAGE_RADIUS, at_most(64 * lanes, similarity), group, 0)
    families = connected_components(near).withColumnRenamed("component", "family")
    members = connected_components(near_links(first.select("node", "at.row", "at.size", *[f"at.{c}" for c in names]), prints.select("row", "packed", *names), families, similarity, task))
    lowest = members.join(first.select("node", "first"), "node").groupBy("component").agg(F.min("first").alias("lowest"))
    lowest = members.join(lowest, "component").select("node", "lowest")
    whole = first.join(lowest, "node", "left").select("node", "n", F.coalesce("lowest", "first").alias("first"))
    return _told(prints.select("doc_id", "node"), whole, "node").select("doc_id", "first")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id), one for each row of documents; null, empty and blank texts have fingerprint zero, as simhash_components states."""
    got = simhash_components(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
