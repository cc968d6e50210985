"""Column and table operators: look-up by role, defaults, gather, scatter, remapping of references, masks, reducers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import GraphError
from ..graph import by_role, metadata
from .derive import reduced


def require(df: DataFrame, name: str, dtype: str | None = None) -> Column:
    """A column by name (E_UNKNOWN_COLUMN), of a type if given (E_COLUMN_TYPE)."""
    if name not in df.columns:
        raise GraphError("E_UNKNOWN_COLUMN", name)
    found = df.schema[name].dataType.simpleString()
    if dtype is not None and found != dtype:
        raise GraphError("E_COLUMN_TYPE", f"{name} is {found}, not {dtype}")
    return df[name]


def require_role(df: DataFrame, role: str) -> Column:
    name = by_role(df, role)
    if name is None:
        raise GraphError("E_UNKNOWN_COLUMN", f"no column of role {role}")
    return df[name]


def set_column(df: DataFrame, name: str, value: Column, replace: bool = False, **meta) -> DataFrame:
    if name in df.columns and not replace:
        raise GraphError("E_COLUMN_EXISTS", name)
    out = df.withColumn(name, value)
    return metadata(out, name, **meta) if meta else out


def remove_column(df: DataFrame, name: str) -> DataFrame:
    require(df, name)
    return df.drop(name)


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    require(df, old)
    if new in df.columns:
        raise GraphError("E_COLUMN_EXISTS", new)
    return df.withColumnRenamed(old, new)


def value(df: DataFrame, name: str) -> Column:
    """The cells of a column, the declared default where they are unset (null)."""
    require(df, name)
    default = df.schema[name].metadata.get("default")
    return F.col(name) if default is None else F.coalesce(F.col(name), F.lit(default).cast(df.schema[name].dataType))


def is_set(df: DataFrame, name: str) -> Column:
    return require(df, name).isNotNull()


def materialize_default(df: DataFrame, name: str) -> DataFrame:
    """Unset cells get the declared default (E_NO_DEFAULT if there is none)."""
    require(df, name)
    if "default" not in df.schema[name].metadata:
        raise GraphError("E_NO_DEFAULT", name)
    meta = df.schema[name].metadata
    return df.withColumn(name, value(df, name)).withMetadata(name, meta)


def slice_rows(df: DataFrame, key: str, first: int, past: int) -> DataFrame:
    return df.filter((F.col(key) >= first) & (F.col(key) < past))


def codes(df: DataFrame, key: str, name: str) -> DataFrame:
    """(key, code): dictionary codes by first appearance; unset cells have none. Numbers the distinct values only."""
    from .._tables import Scratch, numbered

    firsts = df.filter(F.col(name).isNotNull()).groupBy(name).agg(F.min(key).alias("__first"))
    listed = numbered(firsts, ["__first"], "code", Scratch(df.sparkSession)).select(name, "code")
    return df.select(key, name).join(listed, name, "left").select(key, "code")


def remap(values: DataFrame, remap_: DataFrame, key: str = "idx") -> DataFrame:
    """values (key, ...) moved from old to new rows by (old, new); dropped rows go."""
    m = remap_.filter("new is not null").select(F.col("old").alias(key), F.col("new").alias("__new"))
    return values.join(m, key).select(F.col("__new").alias(key), *[c for c in values.columns if c != key])


def gather(values: DataFrame, origin: DataFrame, key: str = "idx") -> DataFrame:
    """Rows of values for the new rows of (key, old)."""
    o = origin.select(F.col("old").alias("__old"), F.col(key).alias("__new"))
    return o.join(values, F.col("__old") == F.col(key), "left").select(F.col("__new").alias(key), *[c for c in values.columns if c != key])


def scatter(target: DataFrame, values: DataFrame, origin: DataFrame, key: str = "idx") -> DataFrame:
    """target (key, value) with the values of new rows written back to the old rows they come from."""
    back = values.join(origin, key).select(F.col("old").alias("__old"), F.col("value").alias("__value"), F.lit(True).alias("__hit"))
    return target.join(back, F.col(key) == F.col("__old"), "left").select(key, F.when(F.col("__hit"), F.col("__value")).otherwise(F.col("value")).alias("value"))


def remap_references(df: DataFrame, name: str, remap_: DataFrame, key: str) -> DataFrame:
    """df with the indices in a column (or in an array column) rewritten; dangling ones become null (or leave)."""
    m = remap_.select(F.col("old").alias("__old"), F.col("new").alias("__new"))
    if df.schema[name].dataType.typeName() != "array":
        return df.join(m, F.col(name) == F.col("__old"), "left").withColumn(name, F.col("__new")).select(*df.columns)
    flat = df.select(key, F.posexplode(name).alias("__pos", "__v")).join(m, F.col("__v") == F.col("__old")).filter("__new is not null")
    lists = flat.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__pos", "__new"))), lambda x: x["__new"]).alias("__list"))
    none = F.when(F.col(name).isNotNull(), F.array().cast(df.schema[name].dataType))
    return df.join(lists, key, "left").withColumn(name, F.coalesce("__list", none)).select(*df.columns)


def with_components(name: str, components: int, fill: float = 0.0) -> Column:
    """An array column with so many components a row: cut, or filled up."""
    padded = F.concat(F.slice(F.col(name), 1, components), F.array_repeat(F.lit(fill), components))
    return F.when(F.col(name).isNotNull(), F.slice(padded, 1, components))


def mask_to_indices(mask: DataFrame, key: str = "idx") -> DataFrame:
    """(key) of the rows of (key, set) that are set."""
    return mask.filter("set").select(key)


def mask_count(mask: DataFrame) -> DataFrame:
    return mask.agg(F.count_if("set").alias("set"))


def make_mask(rows: DataFrame, indices: DataFrame, key: str = "idx") -> DataFrame:
    """(key, set) for all rows; an index that isn't there is E_MASK_LENGTH."""
    if indices.join(rows.select(key), key, "left_anti").limit(1).count():
        raise GraphError("E_MASK_LENGTH", "an index is outside the table")
    hit = indices.select(key).distinct().withColumn("__hit", F.lit(True))
    return rows.select(key).join(hit, key, "left").select(key, F.coalesce("__hit", F.lit(False)).alias("set"))


def packed_mask(mask: DataFrame, key: str = "idx") -> DataFrame:
    """(word, bits): 32-bit words of a mask, as LONG."""
    bit = F.when(F.col("set"), F.expr(f"shiftleft(1L, CAST({key} % 32 AS INT))")).otherwise(F.lit(0).cast("long"))
    return mask.groupBy(F.floor(F.col(key) / 32).alias("word")).agg(F.bit_or(bit).alias("bits"))


def reduce_columns(df: DataFrame, group: str, order: str, reducers: dict[str, str]) -> DataFrame:
    """(group, ...): each named column reduced over its group by first, last, sum, min, max, mean or count."""
    out = reduced(df, [F.col(group)], order, reducers)
    return out.select(group, *[F.col(f"__r_{n}").alias(n) for n, how in reducers.items() if how != "drop"])


#: How a column type reaches a device that has 32-bit words.
ELIGIBLE = {"float": "direct", "int": "direct", "bigint": "direct", "double": "convert", "smallint": "packed", "boolean": "packed"}


def device_eligibility(df: DataFrame, name: str) -> str:
    require(df, name)
    return ELIGIBLE.get(df.schema[name].dataType.simpleString(), "none")
