"""Small fixtures as formulas over a row number."""

from pyspark.sql import functions as F

i = F.col("row_id")


def numbered(spark, n):
    return spark.range(n).withColumnRenamed("id", "row_id")


def pick(values, by=3):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (i % by + 1).cast("int"))


def honest(spark, n=300):
    return numbered(spark, n).select(
        "row_id", F.round(i * 1.31, 2).alias("spend"), pick(["basic", "pro", "enterprise"]).alias("plan"),
        (i % 37).alias("tenure"), (i % 4 == 0).alias("churned"),
    )


def accuracy_folds(spark, key, accuracies, rows=40, split="cv"):
    """Per fold the first round(a * rows) predictions are right; labels alternate; p follows the guess."""
    data = []
    for fold, a in enumerate(accuracies):
        right = round(a * rows)
        for r in range(rows):
            truth = "yes" if r % 2 else "no"
            guess = truth if r < right else ("no" if truth == "yes" else "yes")
            p = 0.9 if guess == "yes" else 0.1
            data.append(("run", key, fold * rows + r, split, fold, truth, guess, [1 - p, p]))
    return spark.createDataFrame(
        data, "run_id string, contender_key string, row_id long, split string, fold int, y_true string, y_pred string, proba array<float>"
    )


def facts(spark, rows):
    return spark.createDataFrame(
        [("run", k, b, s, c) for k, b, s, c in rows], "run_id string, contender_key string, is_baseline boolean, state string, cost double"
    )
