"""Label metrics over pairs of expected and predicted answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.labels import equivalent_subclasses, flag, normalize_answer, normalize_consideration, normalize_label
from gaugeworks.taxonomy import CONSIDERATIONS, ERROR_PREFIX, TASK_KINDS


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def is_error(predicted: Column) -> Column:
    return F.coalesce(predicted.startswith(ERROR_PREFIX), F.lit(False))


def accuracy(df: DataFrame, by: list[str], expected: str = "expected", predicted: str = "predicted") -> DataFrame:
    """n, hits and accuracy; a missing prediction is a miss."""
    hit = F.count_if(F.col(expected) == F.col(predicted))
    return df.groupBy(*by).agg(F.count("*").alias("n"), hit.alias("hits"), ratio(hit, F.count("*")).alias("accuracy"))


def per_class(df: DataFrame, by: list[str], expected: str = "expected", predicted: str = "predicted") -> DataFrame:
    """n, correct and accuracy per expected class; failed rows don't count."""
    rows = df.where(~is_error(F.col(predicted)))
    return accuracy(rows, [*by, expected], expected, predicted).withColumnsRenamed({expected: "class", "hits": "correct"})


def rounded(c: Column, digits: int | None) -> Column:
    return c if digits is None else F.round(c, digits)


def macro_accuracy(df: DataFrame, by: list[str], expected: str = "expected", predicted: str = "predicted", digits: int | None = None) -> DataFrame:
    """Mean of the class accuracies; with ``digits`` these are rounded first, and so is the mean."""
    mean = rounded(F.avg(rounded(F.col("accuracy"), digits)), digits)
    return per_class(df, by, expected, predicted).groupBy(*by).agg(F.count("*").alias("classes"), mean.alias("macro_accuracy"))


def confusion(df: DataFrame, by: list[str], expected: str = "expected", predicted: str = "predicted") -> DataFrame:
    """Counts of each pair that occurs; failed rows don't count."""
    return df.where(~is_error(F.col(predicted))).groupBy(*by, expected, predicted).agg(F.count("*").alias("n"))


def dense_confusion(cells: DataFrame, labels: list[str], expected: str = "expected", predicted: str = "predicted") -> DataFrame:
    """A row per expected label and a column per predicted one, zeros included."""
    wide = cells.groupBy(expected).pivot(predicted, labels).agg(F.sum("n"))
    all_ = cells.sparkSession.createDataFrame([(x,) for x in labels], f"{expected} string")
    return F.broadcast(all_).join(wide, expected, "left").na.fill(0, labels)


def confusion_accuracy(cells: DataFrame, by: list[str], expected: str = "expected", predicted: str = "predicted") -> DataFrame:
    right = F.sum(F.when(F.col(expected) == F.col(predicted), F.col("n")).otherwise(0))
    return cells.groupBy(*by).agg(F.sum("n").alias("n"), ratio(right, F.sum("n")).alias("accuracy"))


def top_confusions(cells: DataFrame, k: int, expected: str = "expected", predicted: str = "predicted") -> DataFrame:
    """The k largest cells off the diagonal; ties by labels."""
    return cells.where((F.col(expected) != F.col(predicted)) & (F.col("n") > 0)).orderBy(F.desc("n"), expected, predicted).limit(k)


def binary(df: DataFrame, by: list[str], expected: str = "expected", predicted: str = "predicted", positive: str | None = None, digits: int | None = None) -> DataFrame:
    """tp, fp, fn, tn and what follows. Without ``positive`` texts that mean yes are. With
    ``digits`` every rate is rounded, and F1 and F2 are those of the rounded rates."""
    e = flag(F.col(expected)) if positive is None else (F.col(expected).eqNullSafe(F.lit(positive))).cast("int")
    p = flag(F.col(predicted)) if positive is None else (F.col(predicted).eqNullSafe(F.lit(positive))).cast("int")
    count = lambda x, y: F.count_if((e == x) & (p == y))
    cells = df.groupBy(*by).agg(F.count("*").alias("n"), count(1, 1).alias("tp"), count(0, 1).alias("fp"), count(1, 0).alias("fn"), count(0, 0).alias("tn"))
    return with_rates(cells, digits)


def with_rates(cells: DataFrame, digits: int | None = None) -> DataFrame:
    """precision, recall, f1, f2 and accuracy from tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    rates = {"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "accuracy": ratio(tp + tn, tp + fp + fn + tn)}
    rated = cells.withColumns({k: rounded(c, digits) for k, c in rates.items()})
    p, r = F.col("precision"), F.col("recall")
    return rated.withColumns({"f1": rounded(ratio(2 * p * r, p + r), digits), "f2": rounded(ratio(5 * p * r, 4 * p + r), digits)})


def distribution(df: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or []), label).agg(F.count("*").alias("n"))


def score_task(df: DataFrame, task: str, by: list[str], expected: str = "expected", predicted: str = "predicted") -> DataFrame:
    """n, exact match and macro accuracy per group after the normaliser of the task.

    Answers are normalised twice for the label kinds, the second time against the default
    classes, and failed rows count as misses, as their text no longer begins like one.
    """
    pairs = df.withColumns({"__e": normalize_answer(task, F.col(expected)), "__p": normalize_answer(task, F.col(predicted))})
    exact = pairs.groupBy(*by).agg(F.count("*").alias("n"), ratio(F.count_if(F.col("__e") == F.col("__p")), F.count("*")).alias("exact_match"))
    again = pairs.withColumns({"__e": normalize_label(F.col("__e")), "__p": normalize_label(F.col("__p"))})
    macro = macro_accuracy(again, by, "__e", "__p")
    return exact.join(macro, by) if by else exact.crossJoin(F.broadcast(macro))  # both are one row without groups


#: The label that counts as positive in yes/no tasks.
POSITIVE = "yes"


def task_frames(df: DataFrame, task: str, by: list[str], expected: str = "expected", predicted: str = "predicted", k: int = 5, digits: int | None = None) -> dict[str, DataFrame]:
    """Everything a task is scored by, as frames per group: overall (n, exact match and macro
    accuracy; for several classes micro accuracy, which is the exact match), per_class,
    confusion and top_confusions (of all groups together), and binary for yes/no tasks.

    Tasks of documents' classes have a second level: see :func:`hierarchical`. Chained runs
    and clause tasks have no pairs of labels and are an error here.
    """
    kind = TASK_KINDS.get(task, task)
    if kind in ("chained", "contracteval"):
        raise ValueError(f"{task} isn't scored by pairs of labels")
    pairs = df.withColumns({"__e": normalize_answer(task, F.col(expected)), "__p": normalize_answer(task, F.col(predicted))})
    overall = score_task(df, task, by, expected, predicted)
    if digits is not None:
        overall = overall.withColumns({c: F.round(c, digits) for c in ("exact_match", "macro_accuracy")})
    if kind == "multiclass":
        overall = overall.withColumn("micro_accuracy", F.col("exact_match"))
    cells = confusion(pairs, by, "__e", "__p").withColumnsRenamed({"__e": "expected", "__p": "predicted"})
    classes = per_class(pairs, by, "__e", "__p").withColumnRenamed("__e", "class")
    frames = {"overall": overall, "per_class": classes, "confusion": cells}
    together = cells.groupBy("expected", "predicted").agg(F.sum("n").alias("n")) if by else cells
    frames["top_confusions"] = top_confusions(together, k)
    if kind == "legalbench":
        frames["binary"] = binary(pairs, by, "__e", "__p", POSITIVE, digits)
    return frames


def hierarchical(df: DataFrame, by: list[str], doc: tuple[str, str], sub: tuple[str, str]) -> DataFrame:
    """Accuracy of class, subclass (strict and with equivalents) and of both at once."""
    de, dp = (normalize_label(F.col(c)) for c in doc)
    se, sp = (normalize_consideration(F.col(c)) for c in sub)
    rows = df.withColumns({"__d": de == dp, "__s": se == sp, "__q": equivalent_subclasses(se, sp, CONSIDERATIONS)})
    n = F.count("*")
    return rows.groupBy(*by).agg(
        n.alias("n"), ratio(F.count_if("__d"), n).alias("doc_type_accuracy"), ratio(F.count_if("__s"), n).alias("subclass_accuracy"),
        ratio(F.count_if("__q"), n).alias("subclass_accuracy_equiv"), ratio(F.count_if(F.col("__d") & F.col("__s")), n).alias("joint_exact"),
    )
