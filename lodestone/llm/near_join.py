"""N-gram Jaccard join: a MinHash LSH forest, then exact verification.

Documents are compared as sets of runs of five words (lower-cased A-Z; words are
runs of a-z, 0-9 and characters outside ASCII; a shorter text is one run).  Texts
with equal sets are copies and make one class, whose representative alone is
compared; the join links classes whose sets have a Jaccard similarity of 0.8 or
more.

The forest has TREES trees, each a trie over signatures of DEPTH MinHash values; a
node is a prefix of a signature, and the classes that share it are below it.  A
class asks each tree with a prefix, at first its whole signature, and shortens the
prefixes until a partner at the threshold shares one of them with the target
probability (the product of 1 - similarity ** length over the trees is then at most
1 - RECALL).  Prefixes are shortened to the length at which equal ones in all trees
would do, in the trees where few share it first; where a prefix is crowded (more
than CROWDED classes share it) it stays as long as the target allows, so a
document of common passages asks with longer prefixes there than others do.  Two
classes meet if they agree on the prefix of either in some tree.

Met classes are gathered into connected components.  Each pair that met, and no
other, is verified exactly on the whole texts.  A component of a few tiles is
verified as a whole; of a larger one, each node is, and a pair in the first tree in
which it meets, so that work follows the nodes' sizes and not the component's.  A
task holds two tiles of bounded size; only counts and a spanning forest leave it,
never the pairs.

Result: one row for each document row: copy_id (least id of its class), class_id
(least id over all classes connected by links), n_copies, n_links (other
documents at or above the threshold, copies included), n_class_links (other
classes).

Edge cases: a null text is an empty one; texts without words are compared as a
whole (equal ones are copies) and have no links; repeated rows are copies of each
other; rows of one id and different texts are judged each by its own text; rows
with a null key are in no class: class_id and copy_id are null, the counts 0; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import textops as T
from lodestone.llm.bitmaps import bitmap, marked
from lodestone.llm.components import connected_components
from lodestone.scratch import Cuts

WORDS, SIMILARITY = 5, 0.8
TREES, DEPTH, RECALL = 16, 8, 0.999
#: a prefix that more classes share stays long; a component of more tiles is verified by node
CROWDED, LARGE = 64, 4
TILE_ROWS, TILE_CHARS = 256, 4_000_000
#: a class of copies above this and above a thousandth of the rows is joined by broadcast: at most a thousand such
HOT_COPIES = 1000


def prefix_length(trees: int = TREES, depth: int = DEPTH, similarity: float = SIMILARITY, recall: float = RECALL) -> int:
    """The longest prefix, alike in all trees, at which a pair of that similarity shares a node with that probability."""
    for d in range(depth, 0, -1):
        if 1 - (1 - similarity**d) ** trees >= recall:
            return d
    raise ValueError("more trees are needed for this recall")


def shingle_sets(column: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, T.Tokens]:
    t = T.tokenize(column, T.ALNUM, True)
    row, value = T.shingles(t, t.hashes(), words)
    values, offsets = T.row_sets(row, value, t.rows)
    return values, offsets, t


def fingerprints(column: pa.Array, values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """16 bytes a row that are equal for equal sets (for texts without words: for equal texts)."""
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(T.mix(values ^ np.uint64(s)))]) for s in (0x1234567, 0x7654321)]
    out = np.stack([s[offsets[1:]] - s[offsets[:-1]] for s in sums], 1)
    empty = np.flatnonzero(offsets[1:] == offsets[:-1])
    if len(empty):
        data, at = T.buffers(column)
        raw = T.hash_ranges(data, at[empty], at[empty + 1])
        out[empty] = np.stack([T.mix(raw ^ np.uint64(0xABCD)), T.mix(raw ^ np.uint64(0xDCBA))], 1)
    return np.ascontiguousarray(out)


def minhashes(values: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """rows x n least hashes (32 bits); 0 for empty sets."""
    rows = len(offsets) - 1
    out = np.zeros((rows, n), dtype=np.uint32)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        starts = offsets[:-1][full]
        for p, m in enumerate(T.multipliers(n, 41)):
            out[full, p] = np.minimum.reduceat((values * m >> np.uint64(32)).astype(np.uint32), starts)
    return out


def shortened(crowds, trees: int = TREES, depth: int = DEPTH, similarity: float = SIMILARITY, recall: float = RECALL):
    """Column: the prefix lengths of a class in its crowded trees, from an array of (m, t), least crowded first.

    The class's other trees have the shortest length already.  Each crowded prefix, in
    turn, gets the greatest length at which the trees together reach the target, or the
    shortest if none does: structs (t, d).
    """
    low, want = prefix_length(trees, depth, similarity, recall), math.log(1 - recall)
    miss = [0.0] + [math.log(1 - similarity**d) for d in range(1, depth + 1)]

    def step(acc, x):
        rest = acc["sum"] - F.lit(miss[depth])
        d = F.lit(low)
        for n in range(low + 1, depth + 1):
            d = F.when(rest + F.lit(miss[n]) <= F.lit(want), F.lit(n)).otherwise(d)
        return F.struct((rest + F.get(F.array(*[F.lit(v) for v in miss]), d)).alias("sum"), F.concat(acc["out"], F.array(F.struct(x["t"].alias("t"), d.alias("d")))).alias("out"))

    n = F.size(crowds)
    zero = F.struct(((F.lit(trees) - n) * F.lit(miss[low]) + n * F.lit(miss[depth])).alias("sum"), F.array().cast("array<struct<t:int,d:int>>").alias("out"))
    return F.aggregate(crowds, zero, step, lambda acc: acc["out"])


def _binary(rows: np.ndarray) -> pa.Array:
    raw, width = np.ascontiguousarray(rows).tobytes(), rows.shape[1] * rows.itemsize
    return pa.array([raw[i : i + width] for i in range(0, len(raw), width)], pa.binary())


def _text(text: str):
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def signatures(docs: DataFrame, key: str, text: str, words: int, trees: int, depth: int) -> DataFrame:
    """(k, th, n, chars, fp, sig): one pass, no shuffle.  th tells texts under one key apart."""

    def run(batches):
        for batch in batches:
            for part in T.slices(batch):
                column = part.column("text")
                values, offsets, t = shingle_sets(column, words)
                yield pa.RecordBatch.from_arrays(
                    [part.column("k"), part.column("th"), pa.array(np.diff(offsets), pa.int32()), pa.array(np.diff(t.offsets), pa.int64()), _binary(fingerprints(column, values, offsets)), _binary(minhashes(values, offsets, trees * depth))],
                    ["k", "th", "n", "chars", "fp", "sig"],
                )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.xxhash64(_text(text)).alias("th"), _text(text).alias("text"))
    return rows.mapInArrow(run, f"k {kind}, th long, n int, chars long, fp binary, sig binary")


def _prefix(path, d):
    """The first d values of a path, as bytes."""
    return F.substring(path, F.lit(1), d * 4) if not isinstance(d, int) else F.substring(path, 1, 4 * d)


def ask_forest(classes: DataFrame, cuts: Cuts, trees: int, depth: int, similarity: float, recall: float, crowded: int) -> tuple[DataFrame, DataFrame]:
    """(shared, asked): the classes (fp, sig) below nodes of several, at the shortest prefix and at those asked with.

    shared: (fp, t, path, node, m, d), d the prefix's length.  asked: (fp, node, asks),
    one row for each prefix at which a class may be met; asks: it asks with it itself.
    """
    low = prefix_length(trees, depth, similarity, recall)
    row = F.explode(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("t"), F.substring(F.col("sig"), t * (4 * depth) + 1, F.lit(4 * depth)).alias("path")))).alias("r")
    rows = classes.where("n > 0").select("fp", row).select("fp", "r.t", "r.path").withColumn("node", F.xxhash64("t", _prefix(F.col("path"), low)))
    # what is joined back on a skewed key is written first, so that the join's sides are plain shuffles, which can be split
    sizes = cuts.cut(rows.groupBy("node").agg(F.count("*").alias("m")).where("m > 1"))
    shared = cuts.cut(rows.join(sizes, "node"))
    crowds = shared.where(F.col("m") > crowded).groupBy("fp").agg(F.array_sort(F.collect_list(F.struct("m", "t"))).alias("crowds"))
    lengths = cuts.cut(crowds.select("fp", F.inline(shortened(F.col("crowds"), trees, depth, similarity, recall))))
    shared = cuts.cut(shared.join(lengths, ["fp", "t"], "left").withColumn("d", F.coalesce("d", F.lit(low))))
    plain = shared.where(F.col("m") <= crowded).select("fp", "node", F.lit(True).alias("asks"))
    at = shared.where(F.col("m") > crowded).withColumn("l", F.explode(F.sequence(F.lit(low), F.lit(depth))))
    asked = plain.unionAll(at.select("fp", F.xxhash64("t", "l", _prefix(F.col("path"), F.col("l"))), F.col("l") == F.col("d")))
    return shared, asked


def _met(sig: list[np.ndarray], lengths: list[np.ndarray], low: int) -> np.ndarray:
    """left x right: the first tree in which two classes meet, or the number of trees.

    sig: rows x trees x depth; lengths: rows x trees, the lengths of their prefixes.
    """
    (a, b), (da, db) = sig, lengths
    trees, depth = a.shape[1:]
    first = np.full((len(a), len(b)), trees, dtype=np.int16)
    both = np.concatenate([a, b])
    for t in range(trees - 1, -1, -1):
        most = max(int(da[:, t].max(initial=low)), int(db[:, t].max(initial=low)))
        met = np.zeros(first.shape, dtype=bool)
        for d in range(low, most + 1):
            # equal prefixes get equal numbers
            _, number = np.unique(np.ascontiguousarray(both[:, t, :d]).view(f"V{4 * d}").ravel(), return_inverse=True)
            equal = number[: len(a), None] == number[None, len(a) :]
            met |= equal if most == low else equal & ((da[:, t] == d)[:, None] | (db[:, t] == d)[None, :])
        first[met] = t
    return first


def _linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, met: np.ndarray, threshold: float) -> np.ndarray:
    """left x right: whether two sets that met are at or above the threshold."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    x, y = sizes[left][:, None], sizes[right][None, :]
    met = met & (np.minimum(x, y) >= threshold * np.maximum(x, y) - 1e-9)
    shared = np.zeros(met.shape, dtype=np.float64)
    if met.sum() <= max(64, met.size // 16):
        for i in np.flatnonzero(met.any(1)).tolist():
            own, js = sets[left[i]], np.flatnonzero(met[i])
            other = np.concatenate([sets[k] for k in right[js]])
            hit = own[np.minimum(np.searchsorted(own, other), len(own) - 1)] == other
            shared[i, js] = np.bincount(np.repeat(np.arange(len(js)), sizes[right[js]]), weights=hit, minlength=len(js))
    else:
        at = np.unique(np.concatenate([left, right]))
        value = np.concatenate([sets[i] for i in at])
        owner = np.repeat(np.arange(len(at)), sizes[at])
        _, col, count = np.unique(value, return_inverse=True, return_counts=True)
        several = count[col] > 1  # what one set has alone is shared with none
        col, owner = col[several], owner[several]
        order = np.argsort(col, kind="stable")
        col, owner = col[order], owner[order]
        place = np.full(len(sets), -1)
        place[at] = np.arange(len(at))
        l, r = place[left], place[right]
        dense = np.unique(col, return_inverse=True)[1]
        width = 4096
        for lo in range(0, int(dense[-1]) + 1 if len(dense) else 0, width):
            a, b = np.searchsorted(dense, [lo, lo + width])
            z = np.zeros((len(at), width), dtype=np.float32)
            z[owner[a:b], dense[a:b] - lo] = 1
            shared += z[l] @ z[r].T
    return met & (shared >= threshold * (x + y - shared) - 1e-9)


def _verify(words: int, threshold: float, trees: int, depth: int, low: int):
    """For rows of some tile pairs: each row's links there and the root of its spanning tree."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        unit, tree, ti, tj, tile = (table.column(c).to_pylist() for c in ("unit", "tree", "ti", "tj", "tile"))
        fp, copies = table.column("fp").to_pylist(), np.array(table.column("copies").to_pylist(), dtype=np.int64)
        sets: list[np.ndarray] = []
        good = []
        for part in T.slices(table.select(["text"])):
            values, offsets, _ = shingle_sets(part.column("text"), words)
            prints = fingerprints(part.column("text"), values, offsets)
            for i in range(part.num_rows):
                good.append(prints[i].tobytes() == bytes(fp[len(sets)]))
                sets.append(values[offsets[i] : offsets[i + 1]])
        sig = np.frombuffer(b"".join(map(bytes, table.column("sig").to_pylist())), dtype=np.uint32).reshape(-1, trees, depth)
        lengths = np.array([x if x is not None else [low] * trees for x in table.column("lengths").to_pylist()], dtype=np.int8).reshape(-1, trees)
        members: dict[tuple, dict[bytes, int]] = {}
        for i, ok in enumerate(good):
            if ok:  # a repeated row is one member
                members.setdefault((unit[i], tree[i], ti[i], tj[i]), {}).setdefault(bytes(fp[i]), i)
        out: dict[str, list] = {"fp": [], "docs": [], "classes": [], "root": []}
        for (_, t, a, b), found in members.items():
            rows = np.array(list(found.values()))
            side = np.array([tile[i] for i in rows])
            left, right = rows[side == a], rows[side == b]
            if not len(left) or not len(right):
                continue
            first = _met([sig[left], sig[right]], [lengths[left], lengths[right]], low)
            met = first == t if t >= 0 else first < trees
            if a == b:
                np.fill_diagonal(met, False)
            linked = _linked(sets, left, right, met, threshold)
            parent = {int(i): int(i) for i in rows}

            def root(x: int, parent=parent) -> int:
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            # joined row by row: a row's links join their roots only where these differ
            for x, line in zip(left.tolist(), linked, strict=True):
                for y in right[line].tolist():
                    p, q = root(x), root(y)
                    if p != q:
                        p, q = (p, q) if bytes(fp[p]) < bytes(fp[q]) else (q, p)
                        parent[q] = p
            docs = {int(i): 0 for i in rows}
            classes = dict(docs)
            for i, x in enumerate(left.tolist()):
                docs[x] += int(copies[right][linked[i]].sum())
                classes[x] += int(linked[i].sum())
            if a != b:
                for j, y in enumerate(right.tolist()):
                    docs[y] += int(copies[left][linked[:, j]].sum())
                    classes[y] += int(linked[:, j].sum())
            for i in docs:
                if classes[i]:
                    out["fp"].append(bytes(fp[i]))
                    out["docs"].append(docs[i])
                    out["classes"].append(classes[i])
                    out["root"].append(bytes(fp[root(i)]))
        return pa.table({"fp": pa.array(out["fp"], pa.binary()), "docs": pa.array(out["docs"], pa.int64()), "classes": pa.array(out["classes"], pa.int64()), "root": pa.array(out["root"], pa.binary())})

    return run


def _tiled(rows: DataFrame, cuts: Cuts, tile_rows: int) -> DataFrame:
    """rows (unit, fp, chars, ...) with q, the number of tiles of their unit."""
    sizes = rows.groupBy("unit").agg(F.count("*").alias("_m"), F.sum("chars").alias("_chars"))
    q = F.greatest(F.ceil(F.col("_m") / tile_rows), F.ceil(F.col("_chars") / TILE_CHARS)).cast("int")
    several = cuts.cut(sizes.select("unit", q.alias("q")).where("q > 1"))
    return rows.join(several, "unit", "left").withColumn("q", F.coalesce("q", F.lit(1)))


def _near(docs: DataFrame, key: str, text: str, words: int, similarity: float, trees: int, depth: int, recall: float, tile_rows: int, crowded: int, large: int) -> tuple[DataFrame, Cuts]:
    """(k, th, copy_id, class_id, class_th, n_copies, n_links, n_class_links) of every row with a key."""
    cuts = Cuts(docs.sparkSession)
    low = prefix_length(trees, depth, similarity, recall)
    sigs = cuts.cut(signatures(docs, key, text, words, trees, depth))
    classes = cuts.cut(sigs.groupBy("fp").agg(F.min(F.struct("k", "th")).alias("rep"), F.count("*").alias("copies"), F.max("n").alias("n"), F.max("chars").alias("chars"), F.first("sig").alias("sig")))
    shared, asked = ask_forest(classes, cuts, trees, depth, similarity, recall, crowded)
    heads = cuts.cut(asked.groupBy("node").agg(F.min("fp").alias("head"), F.count("*").alias("m"), F.bool_or("asks").alias("asks")).where("m > 1 and asks"))
    edges = asked.join(heads.select("node", "head"), "node").where(F.col("fp") != F.col("head")).select(F.col("fp").alias("a"), F.col("head").alias("b"))
    comps = connected_components(edges, cuts).select(F.col("node").alias("fp"), F.col("component").alias("unit"))
    members = _tiled(comps.join(classes.select("fp", "chars"), "fp"), cuts, tile_rows)
    small, big = members.where(F.col("q") <= large), members.where(F.col("q") > large)
    by_node = _tiled(big.select("fp", "chars").join(shared.select("fp", "t", F.col("node").alias("unit")), "fp"), cuts, tile_rows)
    units = small.select("unit", F.lit(-1).alias("tree"), "fp", "q").unionAll(by_node.select(F.to_binary(F.hex("unit"), F.lit("hex")), F.col("t").alias("tree"), "fp", "q"))
    longer = shared.where(F.col("d") > low).groupBy("fp").agg(F.map_from_entries(F.collect_list(F.struct("t", "d"))).alias("longer"))
    lengths = F.when(F.col("longer").isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.coalesce(F.element_at("longer", t), F.lit(low))))
    wide = units.join(classes.select("fp", F.col("rep.k").alias("k"), F.col("rep.th").alias("th"), "copies", "chars", "sig"), "fp").join(longer, "fp", "left")
    wide = cuts.cut(wide.withColumn("lengths", lengths).drop("longer").withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("q")).cast("int")))
    rows, chars = wide.agg(F.count("*"), F.sum("chars")).first()
    bundles = max(1, -(-rows // tile_rows), -(-(chars or 0) // TILE_CHARS))
    texts = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.xxhash64(_text(text)).alias("th"), _text(text).alias("text"))
    texts = marked(texts, ["k", "th"], bitmap(wide.select("k", "th").distinct(), ["k", "th"], cuts), "may").where("may").drop("may")
    pairs = F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("other")
    dealt = texts.join(wide.hint("shuffle_hash"), ["k", "th"]).select("*", pairs)
    ti, tj = F.least("tile", "other"), F.greatest("tile", "other")
    bundle = F.when(F.col("q") == 1, F.pmod(F.xxhash64("unit", "tree"), F.lit(bundles))).otherwise(F.xxhash64("unit", "tree", ti, tj))
    dealt = dealt.select("unit", "tree", "fp", "copies", "text", "sig", "lengths", "tile", ti.alias("ti"), tj.alias("tj"), bundle.alias("bundle"))
    links = cuts.cut(dealt.groupBy("bundle").applyInArrow(_verify(words, similarity, trees, depth, low), "fp binary, docs long, classes long, root binary"))
    sums = links.groupBy("fp").agg(F.sum("docs").alias("docs"), F.sum("classes").alias("classes"))
    labels = connected_components(links.select(F.col("fp").alias("a"), F.col("root").alias("b")), cuts)
    infos = classes.select("fp", "rep", "copies").join(labels.withColumnRenamed("node", "fp"), "fp", "left").join(sums, "fp", "left")
    infos = cuts.cut(infos.withColumn("component", F.coalesce("component", "fp")))
    least = cuts.cut(infos.groupBy("component").agg(F.min("rep").alias("least")))
    infos = infos.join(least, "component").select(
        "fp", F.col("rep.k").alias("copy_id"), F.col("least.k").alias("class_id"), F.col("least.th").alias("class_th"), F.col("copies").alias("n_copies"),
        (F.col("copies") - 1 + F.coalesce("docs", F.lit(0))).alias("n_links"), F.coalesce("classes", F.lit(0)).cast("long").alias("n_class_links"),
    )
    infos = cuts.cut(infos)
    # the few classes with very many copies go to their rows by broadcast
    total = infos.agg(F.sum("n_copies")).first()[0] or 0
    often = F.col("n_copies") > max(HOT_COPIES, total // 1000)
    plain = sigs.select("k", "th", "fp")
    rest = plain.join(F.broadcast(infos.where(often).select("fp")), "fp", "left_anti").join(infos.where(~often), "fp")
    return plain.join(F.broadcast(infos.where(often)), "fp").unionAll(rest).drop("fp"), cuts


def near_join(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, tile_rows: int = TILE_ROWS, crowded: int = CROWDED, large: int = LARGE) -> DataFrame:
    """(key, copy_id, class_id, n_copies, n_links, n_class_links) of every document row."""
    found, _ = _near(docs, key, text, words, similarity, trees, depth, recall, tile_rows, crowded, large)
    without = docs.where(F.col(key).isNull()).select(F.col(key), F.col(key).alias("copy_id"), F.col(key).alias("class_id"), *[F.lit(0).cast("long").alias(c) for c in ("n_copies", "n_links", "n_class_links")])
    return found.drop("th", "class_th").withColumnRenamed("k", key).unionByName(without)


def keep_one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, tile_rows: int = TILE_ROWS, crowded: int = CROWDED, large: int = LARGE) -> DataFrame:
    """One document row of each class: that of its least id; rows with a null key all stay.

    Of the rows that repeat that id and text one stays; another text under the id is
    judged by its own class.  Only rows that may be among those to drop are shuffled.
    """
    found, cuts = _near(docs, key, text, words, similarity, trees, depth, recall, tile_rows, crowded, large)
    rows = cuts.cut(found.select("k", "th", ((F.col("k") == F.col("class_id")) & (F.col("th") == F.col("class_th"))).alias("chosen")))
    repeated = rows.groupBy("k", "th").count().where("count > 1").select("k", "th")
    doubtful = bitmap(rows.where(~F.col("chosen")).select("k", "th").unionAll(repeated), ["k", "th"], cuts)
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at, body = f"c{names.index(key)}", f"c{names.index(text)}"
    plain = plain.withColumns({"k": F.col(at), "th": F.xxhash64(_text(body))})
    wide = marked(plain, ["k", "th"], doubtful, "may")
    sure = wide.where(F.col("k").isNull() | ~F.col("may"))
    chosen = rows.where("chosen").select("k", "th")
    checked = wide.where(F.col("k").isNotNull() & F.col("may")).join(marked(chosen, ["k", "th"], doubtful, "may").where("may").drop("may").distinct().hint("shuffle_hash"), ["k", "th"], "left_semi").dropDuplicates(["k", "th"])
    return sure.unionByName(checked).drop("k", "th", "may").toDF(*names)
