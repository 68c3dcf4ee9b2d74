"""Boosted trees and forests grown inside tasks, for training sets whose binned rows fit in one.

Spark ML grows all trees by jobs over the rows, one (two stages) a level: 200 rounds of depth 6 are
1,200 jobs one after the other, and each carries more than the work of a few hundred thousand rows.
Here values become bins of one byte once, distributed; the bins of all rows are sent to the tasks, if
they are few enough (``fits``), and a task grows whole trees: boosting in one, each round from the
last, a forest in as many as there are cores.  Larger sets are fitted by Spark ML's own jobs.

Algorithm, settings and result are Spark ML's: candidate thresholds by its rule (from all rows; Spark
takes a sample above 10,000), gini or variance gain, Poisson bootstrap, a choice of features for each
node, no split without gain, leaves with equal answers merged.  The trees are written in the saved
form of Spark ML's models and loaded as such.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string as _parse

from tarmac.operators.attributions import MAX_BROADCAST_NODES
from tarmac.session import shared_path

#: Bytes of bins, labels and weights of all rows that are sent to the tasks at most.
SENT_BYTES = 128 << 20
#: Cells of a histogram that several features share.
JOINT = 1024
#: Rows that are counted together.
TOGETHER = 1 << 16
#: Trees of a forest that a task grows.
TREES = 4
#: Impurity that counts as none (Spark's EPSILON).
PURE = 2.0 ** -52

NODES = ("treeID int, nodeData struct<id int, prediction double, impurity double, impurityStats array<double>, rawCount long, "
         "gain double, leftChild int, rightChild int, split struct<featureIndex int, leftCategoriesOrThreshold array<double>, "
         "numCategories int>>")


# --- values to bins -------------------------------------------------------------------------

def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def splits_of(values: np.ndarray, weights: np.ndarray, most: int) -> np.ndarray:
    """Spark's candidate thresholds: between neighbouring values, or where the weight up to them comes
    closest to equal parts."""
    between = (values[:-1] + values[1:]) / 2.0
    if len(between) <= most:
        return between
    upto = np.cumsum(weights)
    middle, stride = (upto[:-1] + upto[1:]) / 2.0, upto[-1] / (most + 1)
    found, target, at = [], stride, 0
    while True:
        at = max(at, int(np.searchsorted(middle, target, side="right")))
        if at >= len(between):
            return between[np.array(found, np.int64)]
        found.append(at)
        at, target = at + 1, target + stride


def thresholds(rows: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """Candidate thresholds of each feature, from all (x, weight) rows."""
    ddl, answer = "feature int, value double, weight double", "feature int, splits binary"
    counted, found = to_arrow_schema(_parse(ddl)), to_arrow_schema(_parse(answer))

    def count(batches):
        held: list[list] = [[] for _ in range(width)]

        def once(f):
            values, which = np.unique(np.concatenate([v for v, _ in held[f]]), return_inverse=True)
            return values, np.bincount(which, weights=np.concatenate([w for _, w in held[f]]), minlength=len(values))

        for batch in batches:
            x, w = _matrix(batch.column("x"), width), batch.column("weight").to_numpy()
            for f in range(width):
                held[f].append((x[:, f].copy(), w))
                if sum(len(v) for v, _ in held[f]) > 4 * TOGETHER:
                    held[f] = [once(f)]
        for f in range(width if held[0] else 0):
            values, weights = once(f)
            for lo in range(0, len(values), TOGETHER):
                part = slice(lo, lo + TOGETHER)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values[part]), f, np.int32)), pa.array(values[part]),
                                                  pa.array(weights[part])], schema=counted)

    def choose(group: pa.Table) -> pa.Table:
        group = group.sort_by("value")
        splits = splits_of(group.column("value").to_numpy(), group.column("weight").to_numpy(), bins - 1)
        return pa.Table.from_arrays([group.column("feature").combine_chunks()[:1], pa.array([splits.tobytes()], pa.binary())], schema=found)

    each = rows.mapInArrow(count, ddl).groupBy("feature", "value").agg(F.sum("weight").alias("weight"))
    got = {r["feature"]: np.frombuffer(r["splits"], np.float64)
           for r in each.groupBy("feature").applyInArrow(choose, answer).collect()}
    return [got.get(f, np.zeros(0)) for f in range(width)]


def binned(rows: DataFrame, splits: list[np.ndarray]):
    """(bins: a row of one byte a feature, labels, weights) of all rows, in an order that follows them alone."""
    ddl, width = "bins binary, labels binary, weights binary", len(splits)
    schema = to_arrow_schema(_parse(ddl))

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            out = np.empty(x.shape, np.uint8)
            for f, s in enumerate(splits):
                out[:, f] = np.searchsorted(s, x[:, f], side="left")
            parts = (out, batch.column("label").to_numpy().astype(np.uint8), batch.column("weight").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], schema=schema)

    got = rows.mapInArrow(run, ddl).toArrow()
    read = lambda name, kind: np.frombuffer(b"".join(got.column(name).to_pylist()), kind)
    bins, labels, weights = read("bins", np.uint8).reshape(-1, width), read("labels", np.uint8), read("weights", np.float64)
    # One order whatever the partitions, that of a hash of the rows: the same rows give the same model.
    wide = np.zeros((len(bins), 8 * (-(-(width + 1) // 8))), np.uint8)
    wide[:, :width], wide[:, width] = bins, labels
    hashed = np.zeros(len(bins), np.uint64)
    for part in (*wide.view(np.uint64).T, weights.view(np.uint64)):
        hashed = (hashed ^ part) * np.uint64(0x9E3779B97F4A7C15)
        hashed ^= hashed >> np.uint64(29)
    order = np.argsort(hashed)
    return bins[order], labels[order], weights[order]


def fits(rows: int, width: int) -> bool:
    """Whether bins, labels and weights of this many rows may be sent."""
    return 0 < rows * (width + 9) <= SENT_BYTES


# --- trees --------------------------------------------------------------------------------

class Grown:
    """Nodes of a tree, level by level."""

    def __init__(self):
        self.levels: list[dict] = []

    def rows(self, tree: int, schema: pa.Schema, splits: list[np.ndarray]) -> pa.RecordBatch:
        """In the saved form: leaves with equal answers merged, numbered parents first, left before right."""
        start = np.cumsum([0] + [len(x["feature"]) for x in self.levels])
        whole = {k: np.concatenate([x[k] for x in self.levels]) for k in self.levels[0]}
        feature = whole["feature"].copy()
        left = np.full(len(feature), -1, np.int64)
        for d in range(len(self.levels) - 1):
            inner = start[d] + np.flatnonzero(feature[start[d]:start[d + 1]] >= 0)
            left[inner] = start[d + 1] + 2 * np.arange(len(inner))
        size = np.ones(len(feature), np.int64)
        for d in range(len(self.levels) - 2, -1, -1):
            i = start[d] + np.flatnonzero(feature[start[d]:start[d + 1]] >= 0)
            l, r = left[i], left[i] + 1
            same = (feature[l] < 0) & (feature[r] < 0) & (whole["prediction"][l] == whole["prediction"][r])
            feature[i[same]] = -1
            i = i[~same]
            size[i] += size[left[i]] + size[left[i] + 1]
        number = np.full(len(feature), -1, np.int64)
        number[0] = 0
        for d in range(len(self.levels) - 1):
            i = start[d] + np.flatnonzero((feature[start[d]:start[d + 1]] >= 0) & (number[start[d]:start[d + 1]] >= 0))
            number[left[i]] = number[i] + 1
            number[left[i] + 1] = number[i] + 1 + size[left[i]]
        at = np.flatnonzero(number >= 0)
        at = at[np.argsort(number[at])]
        inner, n = feature[at] >= 0, len(at)
        child = np.where(inner, left[at], 0)
        value = np.array([splits[f][b] for f, b in zip(feature[at][inner], whole["bin"][at][inner])], np.float64)
        lists = lambda offsets, x: pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(x))
        stats = whole["stats"][at]
        data, split = schema.field("nodeData").type, schema.field("nodeData").type.field("split").type
        cut = pa.StructArray.from_arrays(
            [pa.array(np.where(inner, feature[at], -1).astype(np.int32)), lists(np.append(0, np.cumsum(inner)), value),
             pa.array(np.full(n, -1, np.int32))], fields=list(split))
        columns = [pa.array(np.arange(n, dtype=np.int32)), pa.array(whole["prediction"][at]), pa.array(whole["impurity"][at]),
                   lists(stats.shape[1] * np.arange(n + 1), stats.reshape(-1)), pa.array(whole["raw"][at].astype(np.int64)),
                   pa.array(np.where(inner, whole["gain"][at], -1.0)),
                   pa.array(np.where(inner, number[child], -1).astype(np.int32)),
                   pa.array(np.where(inner, number[np.minimum(child + 1, len(number) - 1)], -1).astype(np.int32)), cut]
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, tree, np.int32)), pa.StructArray.from_arrays(columns, fields=list(data))],
                                          schema=schema)


def _gini(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    both = np.maximum(zero + one, 1e-300)
    return 1.0 - (zero / both) ** 2 - (one / both) ** 2


def class_tree(bins: np.ndarray, labels: np.ndarray, weights: np.ndarray, times: np.ndarray, splits: list, depth: int,
               features: int, rng) -> Grown:
    """A classification tree on the rows, each ``times`` over; ``features`` are chosen for each node."""
    width, most = bins.shape[1], max(2, *[len(s) + 1 for s in splits])
    has = np.array([len(s) for s in splits])
    i = np.flatnonzero(times)
    # Bins come doubled: the class is the last bit of a cell.
    flat, y, w, raw = 2 * bins[i].reshape(-1), labels[i].astype(np.int64), (times * weights)[i], times[i].astype(np.float64)
    here, node, nodes, grown = np.arange(len(i)) * width, np.zeros(len(i), np.int64), 1, Grown()
    for level in range(depth + 1):
        stats = np.bincount(node * 2 + y, weights=w, minlength=2 * nodes).reshape(nodes, 2)
        rows = {"stats": stats, "raw": np.bincount(node, weights=raw, minlength=nodes), "impurity": _gini(*stats.T),
                "prediction": (stats[:, 1] > stats[:, 0]).astype(np.float64), "gain": np.full(nodes, -1.0),
                "feature": np.full(nodes, -1, np.int64), "bin": np.zeros(nodes, np.int64)}
        grown.levels.append(rows)
        if level == depth:
            break
        if features < width:
            chosen = np.argpartition(rng.random((nodes, width)), features - 1, axis=1)[:, :features]
        else:
            chosen = np.tile(np.arange(width), (nodes, 1))
        total, best = stats.sum(axis=1), np.zeros(nodes)
        cell = node * (2 * most) + y
        for slot in range(features):
            f = chosen[:, slot]
            hist = np.bincount(cell + flat[here + f[node]], weights=w, minlength=2 * most * nodes).reshape(nodes, most, 2)
            left = np.cumsum(hist, axis=1)[:, :-1]
            l0, l1 = left[..., 0], left[..., 1]
            r0, r1 = np.maximum(stats[:, :1] - l0, 0.0), np.maximum(stats[:, 1:] - l1, 0.0)
            lw, rw = l0 + l1, r0 + r1
            gain = rows["impurity"][:, None] - (lw * _gini(l0, l1) + rw * _gini(r0, r1)) / total[:, None]
            # A side is empty if what is left of the weight is rounding.
            none = (lw <= 0) | (rw <= 1e-9 * total[:, None]) | (np.arange(most - 1) >= has[f][:, None])
            gain[none] = -1.0
            cut = (gain >= (gain.max(axis=1) - 1e-14)[:, None]).argmax(axis=1)
            gain = gain[np.arange(nodes), cut]
            better = gain > best + 1e-14
            best[better], rows["bin"][better], rows["feature"][better] = gain[better], cut[better], f[better]
        rows["feature"][rows["impurity"] < PURE] = -1
        inner = rows["feature"] >= 0
        rows["gain"][inner] = best[inner]
        if not inner.any():
            break
        child = np.full(nodes, -1, np.int64)
        child[inner] = 2 * np.arange(np.count_nonzero(inner))
        go = np.flatnonzero(child[node] >= 0)
        here, node, y, w, raw = here[go], node[go], y[go], w[go], raw[go]
        node = child[node] + (flat[here + rows["feature"][node]] > 2 * rows["bin"][node])
        nodes = 2 * int(np.count_nonzero(inner))
    return grown


class Joint:
    """Several features counted together: a cell for each combination of their bins."""

    def __init__(self, bins: np.ndarray, splits: list):
        sizes = [len(s) + 1 for s in splits]
        self.groups: list = []
        for f in sorted(range(len(sizes)), key=lambda f: -sizes[f]):
            for g in self.groups:
                if math.prod(sizes[x] for x in g) * sizes[f] <= JOINT:
                    g.append(f)
                    break
            else:
                self.groups.append([f])
        self.sizes, self.most = sizes, max(2, *sizes)
        self.cells = [math.prod(sizes[f] for f in g) for g in self.groups]
        self.keys = []
        for g in self.groups:
            key = np.zeros(len(bins), np.uint16)
            for f in g:
                key = key * np.uint16(sizes[f]) + bins[:, f]
            self.keys.append(key)

    def empty(self, nodes: int) -> list:
        return [np.zeros((2, nodes * cells)) for cells in self.cells]

    def count(self, total: list, node: np.ndarray, rows, target: np.ndarray) -> None:
        """Add (count, sum of the target) of some rows, by node and cell."""
        for key, cells, both in zip(self.keys, self.cells, total):
            at = node * cells
            at += key[rows]
            size = both.shape[1]
            both[0] += np.bincount(at, minlength=size)
            both[1] += np.bincount(at, weights=target, minlength=size)

    def by_bin(self, total: list, nodes: int) -> np.ndarray:
        """(count, sum) by node, feature and bin."""
        out = np.zeros((2, nodes, len(self.sizes), self.most))
        for g, both in zip(self.groups, total):
            shape = both.reshape(2, nodes, *[self.sizes[f] for f in g])
            for k, f in enumerate(g):
                out[:, :, f, :self.sizes[f]] = shape.sum(axis=tuple(2 + j for j in range(len(g)) if j != k))
        return out


def value_tree(joint: Joint, bins: np.ndarray, target: np.ndarray, splits: list, depth: int) -> tuple[Grown, np.ndarray]:
    """A regression tree for a target and its answers for the rows."""
    size, width = bins.shape
    ok = np.arange(joint.most - 1)[None, :] < np.array([len(s) for s in splits])[:, None]
    flat, begin = bins.reshape(-1), np.arange(min(size, TOGETHER)) * width
    parts = [slice(lo, min(size, lo + TOGETHER)) for lo in range(0, size, TOGETHER)]
    node, answers, grown, nodes = np.zeros(size, np.int64), np.zeros(size), Grown(), 1
    count, total, kept, last = np.array([float(size)]), np.array([target.sum()]), None, None
    for level in range(depth + 1):
        # Only the smaller of two children is counted, the other is what is left of the parent.
        if level:
            small = np.argmin(count.reshape(-1, 2), axis=1) + 2 * np.arange(nodes // 2)
            place = np.full(nodes + 1, -1, np.int64)
            place[small] = np.arange(nodes // 2)
        found, square = joint.empty(max(1, nodes // 2)), np.zeros(nodes + 1)
        for part in parts:   # small parts stay in the processor's cache
            here, of = node[part], target[part]
            if level:
                child, feature, cut, leaf = last
                if leaf is not None:
                    answers[part] += leaf[here]
                here = child[here] + (flat[part.start * width:][begin[:len(here)] + feature[here]] > cut[here])
                node[part] = here
            square += np.bincount(here, weights=of * of, minlength=nodes + 1)
            if level < depth:
                if level:
                    to = place[here]
                    i = np.flatnonzero(to >= 0)
                    joint.count(found, to[i], part.start + i, of[i])
                else:
                    joint.count(found, here, part, of)
        stats = np.stack([count, total, square[:nodes]], axis=1)
        impurity = (stats[:, 2] - total * total / count) / count
        rows = {"stats": stats, "raw": count, "impurity": impurity, "prediction": total / count, "gain": np.full(nodes, -1.0),
                "feature": np.full(nodes, -1, np.int64), "bin": np.zeros(nodes, np.int64)}
        grown.levels.append(rows)
        if level < depth:
            hist = joint.by_bin(found, max(1, nodes // 2))
            if level:
                both = np.empty((2, nodes, width, joint.most))
                both[:, small], both[:, small ^ 1] = hist, kept - hist
                hist = both
                hist[1][hist[0] == 0] = 0.0
            left = np.cumsum(hist, axis=3)[..., :-1]
            n, s = left
            other_n, other_s = count[:, None, None] - n, total[:, None, None] - s
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = (s * s / n + other_s * other_s / other_n - (total * total / count)[:, None, None]) / count[:, None, None]
            gain[(n == 0) | (other_n == 0) | ~ok[None]] = -1.0
            gain = gain.reshape(nodes, -1)
            # The first of equal ones; less than rounding is no gain.
            best = (gain >= (gain.max(axis=1) - 1e-12 * np.abs(impurity))[:, None]).argmax(axis=1)
            best_gain = gain[np.arange(nodes), best]
            split = (best_gain > 1e-14 * np.maximum(impurity, PURE)) & (impurity >= PURE)
            rows["feature"][split], rows["bin"][split] = (best // (joint.most - 1))[split], (best % (joint.most - 1))[split]
            rows["gain"][split] = best_gain[split]
        inner = rows["feature"] >= 0
        leaf = np.append(np.where(inner, 0.0, rows["prediction"]), 0.0)
        if not inner.any():
            answers += leaf[node]
            break
        # Rows of leaves go on in a place of their own behind all nodes.
        after = 2 * int(np.count_nonzero(inner))
        child = np.full(nodes + 1, after, np.int64)
        child[:-1][inner] = 2 * np.arange(after // 2)
        last = (child, np.append(np.maximum(rows["feature"], 0), 0), np.append(np.where(inner, rows["bin"], 255), 255),
                None if inner.all() else leaf)
        at = (np.flatnonzero(inner), best[inner])
        ones = [x.reshape(nodes, -1)[at] for x in (n, s)]
        count, total = [np.stack([l, x[inner] - l], axis=1).reshape(-1) for l, x in zip(ones, (count, total))]
        nodes, kept = after, hist[:, inner]
    return grown, answers


# --- models -------------------------------------------------------------------------------

def _prepared(est, train: DataFrame, weighted: bool):
    spark, width = train.sparkSession, len(train.select("features").first()[0])
    rows = train.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("label"),
                        (F.col("weight") if weighted else F.lit(1.0)).cast("double").alias("weight"))
    splits = thresholds(rows, width, est.getMaxBins())
    return spark.sparkContext.broadcast((*binned(rows, splits), splits)), width


def _save(est, nodes: DataFrame, path: str, kind: str, tree_kind: str, width: int, tree_weights: list, more: dict) -> None:
    """Trees as a saved model of Spark ML."""
    spark = nodes.sparkSession
    nodes.write.mode("overwrite").parquet(f"{path}/data")
    settings = shared_path(spark, "settings", unique=True)
    est.write().save(settings)
    own = json.loads(spark.read.text(f"{settings}/metadata").first()[0])
    whole = own | {"class": f"org.apache.spark.ml.classification.{kind}", "numFeatures": width, "numTrees": len(tree_weights)} | more
    spark.createDataFrame([(json.dumps(whole),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")
    keep = {"maxDepth", "maxBins", "minInstancesPerNode", "minInfoGain", "seed"}
    tree = own | {"class": f"org.apache.spark.ml.{tree_kind}"} | {m: {k: v for k, v in own[m].items() if k in keep}
                                                                 for m in ("defaultParamMap", "paramMap")}
    rows = [(i, json.dumps(tree | {"uid": f"{own['uid']}_{i}"}), w) for i, w in enumerate(tree_weights)]
    spark.createDataFrame(rows, "_1 int, _2 string, _3 double").coalesce(1).write.mode("overwrite").parquet(f"{path}/treesMetadata")


def grow_boosted(est, train: DataFrame, path: str) -> None:
    """Spark's gradient boosting (logistic loss, all rows and features) in one task, saved at ``path``."""
    spark = train.sparkSession
    sent, width = _prepared(est, train, False)
    rounds, depth, step, schema = est.getMaxIter(), est.getMaxDepth(), est.getStepSize(), to_arrow_schema(_parse(NODES))

    def run(batches):
        for _ in batches:
            bins, labels, _w, splits = sent.value
            joint, y = Joint(bins, splits), 2.0 * labels - 1.0
            target, score = y, np.zeros(len(y))
            for i in range(rounds):
                grown, answers = value_tree(joint, bins, target, splits, depth)
                yield grown.rows(i, schema, splits)
                score += answers * (1.0 if i == 0 else step)
                target = 4.0 * y / (1.0 + np.exp(2.0 * y * score))

    nodes = spark.range(0, 1, 1, 1).mapInArrow(run, NODES)
    _save(est, nodes, path, "GBTClassificationModel", "regression.DecisionTreeRegressionModel", width,
          [1.0] + [step] * (rounds - 1), {})
    sent.destroy()


def grow_forest(est, train: DataFrame, path: str) -> None:
    """Spark's random forest (two classes, bootstrap, the square root of the features a node), a few trees
    a task, saved at ``path``."""
    spark = train.sparkSession
    sent, width = _prepared(est, train, True)
    total, depth, seed, schema = est.getNumTrees(), est.getMaxDepth(), est.getSeed(), to_arrow_schema(_parse(NODES))
    features = math.ceil(math.sqrt(width))

    def run(batches):
        for batch in batches:
            bins, labels, weights, splits = sent.value
            for i in batch.column("id").to_pylist():
                rng = np.random.default_rng((seed % (1 << 64), i))   # a seed may be negative
                times = rng.poisson(1.0, len(labels)).astype(np.uint8)
                yield class_tree(bins, labels, weights, times, splits, depth, features, rng).rows(i, schema, splits)

    nodes = spark.range(0, total, 1, max(1, -(-total // TREES))).mapInArrow(run, NODES)
    _save(est, nodes, path, "RandomForestClassificationModel", "classification.DecisionTreeClassificationModel", width,
          [1.0] * total, {"numClasses": 2})
    sent.destroy()


def predicted(rows: DataFrame, path: str) -> DataFrame:
    """(label, prediction, p of class 1) by the trees of a saved model, as its own ``transform`` gives them.

    Spark ML sends a model with each task's code, one object a node: a forest of a million nodes takes
    longer to unpack than to ask.  Here its nodes are a few arrays.
    """
    spark = rows.sparkSession
    nodes, ddl = spark.read.parquet(f"{path}/data"), "label double, prediction double, p double"
    n = nodes.count()
    if n > MAX_BROADCAST_NODES:
        raise ValueError(f"{n} nodes: too large to send")
    if nodes.filter("nodeData.leftChild >= 0 AND nodeData.split.numCategories >= 0").limit(1).count():
        raise ValueError("categorical splits have no threshold: this walk is for continuous features")
    found = nodes.select("treeID", "nodeData.id", "nodeData.prediction", "nodeData.leftChild", "nodeData.rightChild",
                         F.col("nodeData.split.featureIndex").alias("feature"), F.element_at("nodeData.impurityStats", 1).alias("zero"),
                         F.element_at("nodeData.impurityStats", 2).alias("one"),
                         F.try_element_at("nodeData.split.leftCategoriesOrThreshold", F.lit(1)).alias("threshold")) \
        .toArrow().sort_by([("treeID", "ascending"), ("id", "ascending")])
    get = lambda name: found.column(name).to_numpy()
    tree, left, right = get("treeID"), get("leftChild").astype(np.int64), get("rightChild").astype(np.int64)
    roots = np.flatnonzero(np.append(True, tree[1:] != tree[:-1]))
    first = np.repeat(roots, np.diff(np.append(roots, n)))
    leaf, place = left < 0, np.arange(n)
    # Leaves lead to themselves.
    left, right = np.where(leaf, place, left + first), np.where(leaf, place, right + first)
    feature, threshold = np.where(leaf, 0, get("feature")).astype(np.int64), np.where(leaf, np.inf, get("threshold").astype(np.float64))
    weights = [r[0] for r in spark.read.parquet(f"{path}/treesMetadata").orderBy("_1").select("_3").collect()]
    boosted = "GBTClassificationModel" in json.loads(spark.read.text(f"{path}/metadata").first()[0])["class"]
    whole = get("zero") + get("one")
    values = (get("prediction"),) if boosted else (get("zero") / whole, get("one") / whole)
    sent, schema = spark.sparkContext.broadcast((roots, weights, left, right, feature, threshold, values)), to_arrow_schema(_parse(ddl))

    def run(batches):
        roots, weights, left, right, feature, threshold, values = sent.value
        for batch in batches:
            size = batch.num_rows
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False)
            here = np.arange(size) * (len(x) // max(size, 1))
            sums = [np.zeros(size) for _ in values]
            for root, weight in zip(roots, weights):
                node = np.full(size, root)
                while True:
                    after = np.where(x[here + feature[node]] <= threshold[node], left[node], right[node])
                    if (after == node).all():
                        break
                    node = after
                for total, value in zip(sums, values):
                    total += weight * value[node]
            if boosted:
                one, p = sums[0] > 0, 1.0 / (1.0 + np.exp(-2.0 * sums[0]))
            else:
                one, p = sums[1] > sums[0], sums[1] / (sums[0] + sums[1])
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(one.astype(np.float64)), pa.array(p)], schema=schema)

    return rows.select("label", vector_to_array("features").alias("x")).mapInArrow(run, ddl)
