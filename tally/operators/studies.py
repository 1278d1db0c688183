"""Study / slice operators: ordering, feature-store merge, padding, volumes, study pooling.

The long form (study_id, pos, ...) is the working representation: positions come
from an exact distributed rank, stores join on (study_id, pos) — an inner join
on dense positions is exactly truncation to the shortest store — and nested
per-study arrays are only built where the consumer needs them, with a bounded
length (``max_len``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.operators.clean import clean_vector
from tally.operators.ordered import running_counts


def order_slices(slices: DataFrame, study: str = "study_id", order: tuple[str, ...] = ("z_pos", "slice_id"),
                 pos: str = "pos") -> DataFrame:
    """0-based position of each slice inside its study, ordered by z (ties by slice id)."""
    x = slices.withColumn("_ord", F.struct(*[F.col(c) for c in order])).withColumn("_one", F.lit(1))
    r = running_counts(x, [study], "_ord", ["_one"])
    return r.withColumn(pos, (F.col("cum__one") - 1).cast("int")).withColumn("n_slices", F.col("tot__one")) \
        .drop("_ord", "_one", "cum__one", "tot__one")


def feature_store(ordered: DataFrame, vectors: DataFrame, start: int, length: int, drop_last: Column | None = None,
                  study: str = "study_id") -> DataFrame:
    """One extractor's store in long form (study_id, pos, vec) — elements [start, start+length)."""
    x = ordered.join(vectors, "vec_id")
    if drop_last is not None:
        x = x.where(F.col("pos") < F.col("n_slices") - drop_last)
    return x.select(study, "pos", F.slice("px", start, length).alias("vec"))


def merge_stores(stores: list[DataFrame], study: str = "study_id") -> DataFrame:
    """Inner join of the stores on (study, pos) and per-slice concatenation; NaN/Inf -> 0."""
    m = stores[0].withColumnRenamed("vec", "_v0")
    for i, s in enumerate(stores[1:], start=1):
        m = m.join(s.withColumnRenamed("vec", f"_v{i}"), [study, "pos"])
    vec = F.concat(*[F.col(f"_v{i}") for i in range(len(stores))])
    return m.select(study, "pos", clean_vector(vec).alias("vec"))


def study_label(slices: DataFrame, study: str = "study_id", label: str = "label") -> DataFrame:
    """Study label = max slice label (over all slices), slice count."""
    return slices.groupBy(study).agg(F.max(label).alias("label"), F.count(F.lit(1)).alias("n_slices"))


def study_score(slices: DataFrame, study: str = "study_id", score: str = "slice_score", label: str = "label",
                threshold: float = 0.5) -> DataFrame:
    """Max-pooled slice probability per study, prediction score > threshold."""
    return slices.groupBy(study).agg(F.max(score).alias("score"), F.max(label).alias("y")) \
        .withColumn("pred", (F.col("score") > F.lit(threshold)).cast("int"))


def pad_sequences(seq: DataFrame, max_len: int = 60, study: str = "study_id", value_cols: tuple[str, ...] = ("label",),
                  vec_col: str | None = None, dim: int = 0) -> DataFrame:
    """Per study, first ``max_len`` positions, zero padded; loss_mask 1 = real, padding_mask true = pad."""
    x = seq.where(F.col("pos") < max_len)
    fields = [F.col("pos"), *[F.col(c) for c in value_cols]] + ([F.col(vec_col)] if vec_col else [])
    g = x.groupBy(study).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_s"))
    n = F.size("_s")
    pad = F.lit(max_len) - n
    cols = [F.col(study), n.alias("n_real")]
    def field(name):
        return lambda e: e[name].cast("float")

    for c in value_cols:
        vals = F.transform("_s", field(c))
        cols.append(F.concat(vals, F.array_repeat(F.lit(0.0).cast("float"), pad)).alias(f"{c}s"))
    if vec_col:
        zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
        vecs = F.transform("_s", lambda e: e[vec_col].cast("array<float>"))
        cols.append(F.concat(vecs, F.array_repeat(zero, pad)).alias("features"))
    cols.append(F.concat(F.array_repeat(F.lit(1.0).cast("float"), n), F.array_repeat(F.lit(0.0).cast("float"), pad))
                .alias("loss_mask"))
    cols.append(F.concat(F.array_repeat(F.lit(False), n), F.array_repeat(F.lit(True), pad)).alias("padding_mask"))
    return g.select(*cols)


def rescale_window(px: Column | str, slope: float = 1.0, intercept: float = 0.0, lo: float = -1000.0,
                   hi: float = 400.0) -> Column:
    """X * slope + intercept, clipped to [lo, hi], scaled to [0, 1]."""
    c = F.col(px) if isinstance(px, str) else px
    return F.transform(c, lambda x: (F.least(F.greatest(x.cast("double") * slope + intercept, F.lit(lo)), F.lit(hi))
                                     - lo) / (hi - lo))


def stack_volume(ordered: DataFrame, planes: DataFrame, dim: int, on_missing: str = "zero",
                 study: str = "study_id") -> DataFrame:
    """E16 in long form: (study, z, plane) with unreadable slices handled per ``on_missing``.

    ordered: (study, pos, vec_id); planes: (vec_id, plane array<double>, readable).
    'zero': an unreadable slice becomes a zero plane once a readable one was
    seen (leading unreadable slices are dropped); 'skip': unreadable slices are
    dropped. A study with nothing kept gets one zero plane.
    """
    x = ordered.select(study, "pos", "vec_id").join(planes, "vec_id", "left") \
        .withColumn("readable", F.coalesce(F.col("readable"), F.lit(False)))
    zero = F.array_repeat(F.lit(0.0), dim)
    readable = F.col("readable")
    per = x.groupBy(study).agg(F.min(F.when(readable, F.col("pos"))).alias("_first"), F.min("pos").alias("_any"))
    if on_missing == "zero":
        # the row of a study without readable slices that is kept stands for its one zero plane
        y = x.join(per, study).where((F.col("pos") >= F.col("_first")) | (F.col("_first").isNull() & (F.col("pos") == F.col("_any"))))
        return y.select(study, F.coalesce(F.col("pos") - F.col("_first"), F.lit(0)).cast("int").alias("z"),
                        F.when(readable, F.col("plane")).otherwise(zero).alias("plane"))
    r = running_counts(x.where("readable").withColumn("_one", F.lit(1)), [study], "pos", ["_one"])
    kept = r.select(study, (F.col("cum__one") - 1).cast("int").alias("z"), "plane")
    return kept.unionByName(per.where("_first IS NULL").select(study, F.lit(0).alias("z"), zero.alias("plane")))
