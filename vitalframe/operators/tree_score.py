"""Scoring with tree models as column expressions.

A forest or booster becomes flat node arrays, constants of the plan: feature, cut,
children and value of every node of all trees. A row's leaf is found by walking
the arrays with higher-order functions, so a population, what-if scenarios and a
stream are scored inside the same projection as with the linear model: no vector
assembly, no model object on the executors, no Python.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalframe.functions.rounding import half_even
from vitalframe.operators import metrics as ev
from vitalframe.operators.trees import BoostedModel
from vitalframe.schema import CLASSIFICATION_THRESHOLD


@dataclass
class TreeRiskModel:
    """Trees in flat arrays; a node with ``low`` -1 is a leaf, others send values up to their cut to ``low``.

    ``link``: "logit" (1 / (1 + exp(-m))), "logit2" (of twice the margin, as Spark ML's
    boosted trees have it) or "share" (the margin itself). A missing value goes to
    the low side if ``missing_low``, else to the high side.
    """
    features: list[str]
    roots: list[int]
    feature: list[int]
    cut: list[float]
    low: list[int]
    high: list[int]
    value: list[float]
    start: float = 0.0
    link: str = "logit"
    missing_low: bool = False
    center: dict[str, float] = field(default_factory=dict)
    scale: dict[str, float] = field(default_factory=dict)
    threshold: float = CLASSIFICATION_THRESHOLD
    round_digits: int | None = None

    def depth(self) -> int:
        """Levels of the deepest tree."""
        level, most = list(self.roots), 0
        while level := [c for n in level if self.low[n] >= 0 for c in (self.low[n], self.high[n])]:
            most += 1
        return most

    def margin(self) -> Column:
        def constant(values: list, kind: str) -> Column:
            # one literal that the optimiser folds into an array
            return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")

        def input_of(c: str) -> Column:
            x = F.col(c).cast("double")
            if c in self.center:
                x = (x - F.lit(self.center[c])) / F.lit(self.scale.get(c, 1.0))
            return F.when(F.isnan(x), F.lit(None).cast("double")).otherwise(x)

        if not self.roots:
            return F.lit(float(self.start))
        feature, cut, low, high = constant(self.feature, "int"), constant(self.cut, "double"), constant(self.low, "int"), constant(self.high, "int")
        levels = F.sequence(F.lit(1), F.lit(self.depth()))
        value = constant(self.value, "double")

        def total(x: Column) -> Column:
            def step(node: Column, _: Column) -> Column:
                goes_low = F.coalesce(x[feature[node]] <= cut[node], F.lit(self.missing_low))
                return F.when(low[node] < 0, node).when(goes_low, low[node]).otherwise(high[node])

            leaf = (lambda root: F.aggregate(levels, root, step)) if self.depth() else (lambda root: root)
            return F.aggregate(constant(self.roots, "int"), F.lit(float(self.start)), lambda so_far, root: so_far + value[leaf(root)])

        # bound as a variable, the inputs are made once a row, not once a step of every tree
        return F.transform(F.array(F.array(*[input_of(c) for c in self.features])), total)[0]

    def probability(self) -> Column:
        m = self.margin()
        p = m if self.link == "share" else 1 / (1 + F.exp(-(m * 2 if self.link == "logit2" else m)))
        return half_even(p, self.round_digits) if self.round_digits is not None else p

    def prediction(self, p: Column | None = None) -> Column:
        return ((self.probability() if p is None else p) > F.lit(self.threshold)).cast("int")

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(s: str) -> "TreeRiskModel":
        return TreeRiskModel(**json.loads(s))

    @staticmethod
    def from_trees(features: list[str], trees: list[dict], **settings) -> "TreeRiskModel":
        """From one dict of (feature, cut, low, high, value) lists a tree; children count from the tree's own first node."""
        out: dict[str, list] = {k: [] for k in ("roots", "feature", "cut", "low", "high", "value")}
        for t in trees:
            first = len(out["value"])
            out["roots"].append(first)
            for k in ("feature", "cut", "value"):
                out[k] += t[k]
            for k in ("low", "high"):
                out[k] += [c + first if c >= 0 else -1 for c in t[k]]
        return TreeRiskModel(features, **out, **settings)

    @staticmethod
    def from_boosted(model: BoostedModel, **settings) -> "TreeRiskModel":
        """A fitted booster; its bins' bounds become cuts."""
        trees = [{"feature": t["feature"], "low": t["low"], "high": t["high"], "value": [model.rate * v for v in t["value"]],
                  "cut": [float(model.edges[f][b]) if c >= 0 else 0.0 for f, b, c in zip(t["feature"], t["bound"], t["low"])]} for t in model.trees]
        return TreeRiskModel.from_trees(model.features, trees, start=model.start, link="logit", missing_low=True, **settings)

    @staticmethod
    def from_spark(bundle, **settings) -> "TreeRiskModel":
        """A ModelBundle with a Spark ML forest or boosted trees, read from the model's saved nodes (as many rows as nodes)."""
        from vitalframe.session import scratch_dir
        spark = SparkSession.getActiveSession()
        path = scratch_dir(spark, "tree-model")
        bundle.model.write().overwrite().save(path)
        forest = type(bundle.model).__name__ == "RandomForestClassificationModel"
        weight = {r[0]: r[2] for r in spark.read.parquet(f"{path}/treesMetadata").collect()}
        nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").collect()
        trees: dict[int, dict] = {}
        for r in nodes:
            t = trees.setdefault(r.treeID, {k: [] for k in ("feature", "cut", "low", "high", "value")})
            if r.split.featureIndex >= 0 and r.split.numCategories != -1:
                raise ValueError("splits on categories are not supported")
            t["feature"].append(max(r.split.featureIndex, 0))
            t["cut"].append(float(r.split.leftCategoriesOrThreshold[0]) if r.leftChild >= 0 else 0.0)
            t["low"].append(r.leftChild)
            t["high"].append(r.rightChild)
            t["value"].append(r.impurityStats[1] / sum(r.impurityStats) / len(weight) if forest else weight[r.treeID] * r.prediction)
        scaler = bundle.scaler
        return TreeRiskModel.from_trees(bundle.features, [trees[k] for k in sorted(trees)], link="share" if forest else "logit2", center=scaler.center, scale=scaler.scale, **settings)


@dataclass
class BoostedBundle:
    """A fitted booster where a ModelBundle is expected: scored by columns, saved as one JSON record."""
    name: str
    model: BoostedModel
    params: dict = field(default_factory=dict)

    @property
    def features(self) -> list[str]:
        return self.model.features

    def score(self, df: DataFrame, keep: tuple[str, ...] = ("id",), threshold: float = CLASSIFICATION_THRESHOLD) -> DataFrame:
        """(keep..., label?, probability, prediction); E11 is checked."""
        ev.require_features(df.columns, self.features)
        label = [F.col("cardio").cast("int").alias("label")] if "cardio" in df.columns else []
        p = TreeRiskModel.from_boosted(self.model).probability()
        return df.select(*[c for c in keep if c in df.columns], *label, p.alias("probability")).withColumn("prediction", (F.col("probability") > threshold).cast("int"))

    def save(self, path: str) -> None:
        meta = {"name": self.name, "params": self.params, "model_class": "BoostedModel", "model": asdict(self.model)}
        SparkSession.getActiveSession().createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @staticmethod
    def of(meta: dict) -> "BoostedBundle":
        return BoostedBundle(meta["name"], BoostedModel(**meta["model"]), meta["params"])


def _split(feature: int, cut: float, low: dict, high: dict) -> dict:
    """A tree of a cut and two smaller trees."""
    out = {"feature": [feature], "cut": [cut], "low": [1], "high": [1 + len(low["value"])], "value": [0.0]}
    for part in (low, high):
        at = len(out["value"])
        for k in ("feature", "cut", "value"):
            out[k] += part[k]
        for k in ("low", "high"):
            out[k] += [c + at if c >= 0 else -1 for c in part[k]]
    return out


def _leaf(value: float) -> dict:
    return {"feature": [0], "cut": [0.0], "low": [-1], "high": [-1], "value": [value]}


#: An illustrative fixed model, as DEFAULT_RISK_MODEL is for the linear form: results can be stated in SQL.
DEFAULT_TREE_MODEL = TreeRiskModel.from_trees(
    ["ap_hi", "age_years", "cholesterol", "bmi", "smoke", "active"],
    [_split(0, 139.0, _split(1, 54.0, _leaf(-0.9), _leaf(-0.2)), _split(2, 1.0, _leaf(0.5), _leaf(1.1))),
     _split(3, 27.5, _split(4, 0.0, _leaf(-0.3), _leaf(0.15)), _split(0, 124.0, _leaf(0.05), _leaf(0.45))),
     _split(5, 0.0, _leaf(0.25), _split(1, 60.0, _leaf(-0.25), _leaf(0.1)))],
    start=-0.1, round_digits=12)
