"""Comparing JSON trees: as leaf tables in Spark, and single reports on the driver."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from veritab.errors import EvidenceError
from veritab.session import written

TOLERANCE = 1e-9
LEAVES = "path string, kind string, value string"


def flatten(tree: dict, prefix: str = "") -> dict[str, Any]:
    """Dotted paths of the values that aren't dicts; lists are values, empty dicts vanish."""
    out: dict[str, Any] = {}
    waiting = [(prefix, tree)]
    while waiting:
        path, node = waiting.pop()
        for key, value in node.items():
            if isinstance(value, dict):
                waiting.append((f"{path}{key}.", value))
            else:
                out[f"{path}{key}"] = value
    return out


def leaf_table(spark: SparkSession, trees: dict[str, dict]) -> DataFrame:
    """(tree, path, kind, value) of small reports: ``value`` is JSON, null for a JSON null."""
    from veritab.operators.digests import canonical_json

    rows = [(name, path, kind_of(v), None if v is None else canonical_json(v)) for name, tree in trees.items() for path, v in sorted(flatten(tree).items())]
    return spark.createDataFrame(rows, f"tree string, {LEAVES}")


def kind_of(value: Any) -> str:
    if value is None:
        return "null"
    return {bool: "bool", int: "int", float: "float", str: "text"}.get(type(value), "list")


#: Levels of objects opened in one projection; deeper ones are written and opened further.
LEVELS = 4


def _opened(nodes: DataFrame) -> DataFrame:
    """Objects of (key, path, v) replaced by their members; all else stays as it is."""
    members = F.try_variant_get("v", "$", "map<string,variant>")
    before = F.coalesce(F.concat(F.col("path"), F.lit(".")), F.lit(""))
    inner = F.transform(F.map_entries(members), lambda e: F.struct(F.concat(before, e["key"]).alias("path"), e["value"].alias("v")))
    each = F.when(members.isNotNull(), inner).otherwise(F.array(F.struct("path", "v")))
    return nodes.select("key", F.explode(each).alias("x")).select("key", "x.path", "x.v")


def flatten_json(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, kind, value): the leaves of a column of JSON texts.

    Objects are opened level by level in projections, without a shuffle and whatever
    the number of rows; arrays are leaves, empty objects have none.  A null or
    malformed text and one that isn't an object have no leaves.
    """
    nodes = documents.select(F.col(key).alias("key"), F.lit(None).cast("string").alias("path"), F.try_parse_json(text).alias("v"))
    nodes = nodes.where(F.try_variant_get("v", "$", "map<string,variant>").isNotNull())
    leaves = None
    while True:
        for _ in range(LEVELS):
            nodes = _opened(nodes)
        is_object = F.try_variant_get("v", "$", "map<string,variant>").isNotNull()
        flat = nodes.where(~is_object)
        leaves = flat if leaves is None else leaves.unionByName(flat)
        nodes = nodes.where(is_object)
        if nodes.isEmpty():
            break
        nodes = written(nodes, "flatten-json")
    kind = F.schema_of_variant("v")
    name = F.when(kind == "BIGINT", "int").when(kind.isin("DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), "float").when(kind == "BOOLEAN", "bool").when(kind == "STRING", "text").when(kind == "VOID", "null").otherwise("list")
    return leaves.select(F.col("key").alias(key), "path", name.alias("kind"), F.when(kind != "VOID", F.to_json("v")).alias("value"))


def tree_diff(left: DataFrame, right: DataFrame, by: list[str] | None = None, absolute: float = 0.0, relative: float = 0.0) -> DataFrame:
    """(*by, path, left_value, right_value, reason) of the leaves that differ.

    A leaf of one side only is ``missing`` or ``unexpected``, whatever its value;
    of two floats only a gap above the tolerance counts; an int is no float or
    bool.  Non-finite floats always differ.
    """
    by = by or []
    keys = [*by, "path"]
    a = left.select(*keys, F.col("kind").alias("lk"), F.col("value").alias("left_value"), F.lit(True).alias("l"))
    b = right.select(*keys, F.col("kind").alias("rk"), F.col("value").alias("right_value"), F.lit(True).alias("r"))
    joined = a.join(b, keys, "full_outer")
    x, y = F.expr("try_cast(left_value as double)"), F.expr("try_cast(right_value as double)")
    gap = F.abs(x - y)
    close = (gap <= absolute) | (gap <= relative * F.greatest(F.abs(x), F.abs(y)))
    floats = (F.col("lk") == "float") & F.col("rk").isin("float", "int")
    same = F.when(floats, F.coalesce(close & ~F.isnan(gap), F.lit(False))).otherwise(F.col("lk").eqNullSafe(F.col("rk")) & F.col("left_value").eqNullSafe(F.col("right_value")))
    reason = F.when(F.col("l").isNull(), "unexpected").when(F.col("r").isNull(), "missing").when(~same, "different")
    return joined.withColumn("reason", reason).where("reason is not null").select(*keys, "left_value", "right_value", "reason")


def close(actual: float, expected: float, absolute: float = 0.0, relative: float = 0.0) -> bool:
    return math.isfinite(actual) and math.isclose(actual, expected, rel_tol=relative, abs_tol=absolute)


def mismatch(actual: Any, expected: Any, name: str = "", absolute: float = 0.0, relative: float = 0.0) -> str | None:
    """The path of the first leaf where two trees differ, or null.

    Floats may differ by the tolerance; ints must be ints and bools bools.
    """
    if isinstance(expected, dict):
        if not isinstance(actual, dict) or set(actual) != set(expected):
            return name or "."
        children = ((f"{name}.{k}".lstrip("."), actual[k], expected[k]) for k in expected)
    elif isinstance(expected, (list, tuple)):
        if not isinstance(actual, (list, tuple)) or len(actual) != len(expected):
            return name or "."
        children = ((f"{name}[{i}]", a, e) for i, (a, e) in enumerate(zip(actual, expected)))
    elif isinstance(expected, float):
        number = isinstance(actual, (int, float)) and not isinstance(actual, bool)
        return None if number and close(float(actual), expected, absolute, relative) else name or "."
    else:
        return None if type(actual) is type(expected) and actual == expected else name or "."
    return next((found for k, a, e in children if (found := mismatch(a, e, k, absolute, relative))), None)


def require_equal(actual: Any, expected: Any, name: str, absolute: float = 0.0, relative: float = 0.0) -> None:
    if found := mismatch(actual, expected, name, absolute, relative):
        raise EvidenceError(f"{found} is not what its inputs give")
