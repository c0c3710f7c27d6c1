"""Clean-up and checks of generated answers; generation itself is a seam."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarweave.functions.text import strip
from scholarweave.prompt_texts import FALLBACK_OTHER, FALLBACKS, NO_ANSWER, NO_GOOD_ANSWER


def calm(answer: Column) -> Column:
    """Runs of six or more equal characters and words said three times or more shrink to one."""
    once = F.regexp_replace(strip(answer), r"(.)\1{5,}", "$1")
    return F.regexp_replace(once, r"(?U)\b(\w+)(\s+\1){2,}\b", "$1")


def clean_answer(answer: Column, limit: int = 2000) -> Column:
    text = calm(answer)
    cut = F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)
    return F.when(F.coalesce(answer, F.lit("")) == "", F.lit(NO_ANSWER)).otherwise(cut)


def is_meaningless(answer: Column) -> Column:
    """Too short, one character above half of all, too few words, or only marks, digits or repeats."""
    text = strip(F.coalesce(answer, F.lit("")))
    marks = F.filter(F.split(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""), ""), lambda c: c != "")
    kinds = F.array_distinct(marks)
    top = F.array_max(F.transform(kinds, lambda c: F.length(text) - F.length(F.replace(text, c, F.lit("")))))
    few = (
        (F.regexp_count(text, F.lit(r"(?U)\w+")) < 5)
        & (F.regexp_count(text, F.lit("[가-힣]+")) < 2)
        & (F.regexp_count(text, F.lit("[a-zA-Z]+")) < 3)
    )
    only_marks = text.rlike(r"""^[!@#$%^&*()_+\-=\[\]{};:"\\|,.<>/?]+$""")
    return (
        (F.length(text) < 15)
        | F.coalesce(top > F.size(marks) * 0.5, F.lit(False))
        | few
        | only_marks
        | text.rlike(r"^[0-9\s]+$")
        | text.rlike(r"^(.)\1{10,}")
    )


def post_process(answer: Column, max_tokens: int = 500) -> Column:
    text = calm(answer)
    good = F.when(is_meaningless(text), F.lit(NO_GOOD_ANSWER)).otherwise(text)
    limit = max_tokens * 4
    return F.when(F.length(good) > limit, F.concat(F.substring(good, 1, limit), F.lit("..."))).otherwise(good)


def fallback_answer(error: Column) -> Column:
    low = F.lower(error)
    out = None
    for word, text in FALLBACKS.items():
        out = F.when(low.contains(word), text) if out is None else out.when(low.contains(word), text)
    return out.otherwise(FALLBACK_OTHER)


def health(response_ok: Column, seconds: Column) -> Column:
    return F.when(response_ok & (seconds < 60), "healthy").otherwise("degraded")


def max_documents(complexity: Column, limit: int = 10) -> Column:
    """Documents to use for a question of this complexity."""
    return F.when(complexity == "simple", min(5, limit)).when(complexity == "exploratory", min(15, limit + 5)).otherwise(limit)


def generate(prompts: DataFrame, prompt: str, make_model: Callable[[], Callable[[str], str]], retries: int = 3) -> DataFrame:
    """Adds answer, error and attempts. The model is made once per task; a prompt that keeps failing
    leaves an error instead of failing the job.
    """

    @F.pandas_udf("answer string, error string, attempts int")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for part in parts:
            rows = []
            for text in part:
                answer, error, attempt = None, None, 0
                while answer is None and attempt < retries:
                    attempt += 1
                    try:
                        answer, error = model(text), None
                    except Exception as problem:  # noqa: BLE001 - any model error is recorded
                        error = str(problem)
                rows.append((answer, error, attempt))
            yield pd.DataFrame(rows, columns=["answer", "error", "attempts"])

    return prompts.withColumn("_g", run(F.col(prompt))).select(*prompts.columns, "_g.*")


def run_summary(generated: DataFrame) -> DataFrame:
    """One row: prompts, answered, success rate."""
    done = F.count_if(F.col("error").isNull())
    return generated.agg(F.count("*").alias("queries"), done.alias("answered"), F.round(done / F.count("*") * 100, 1).alias("success_rate"))
