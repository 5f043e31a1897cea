"""Rendered prompts and the report on a tuned prompt."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagwright.functions.prompts import Prompt
from tagwright.operators.rows import first_n
from tagwright.session import small_frame
from tagwright.spec import MAX_VOCABULARY

# Headings of the report.
TITLE = "OPTIMIZED PROMPT DETAILS"
INSTRUCTIONS = "SIGNATURE-LEVEL INSTRUCTIONS"
EXAMPLES = "FEW-SHOT EXAMPLES"
SAMPLE = "ACTUAL PROMPT EXAMPLE"
HEADINGS = (TITLE, INSTRUCTIONS, EXAMPLES, SAMPLE)

# How many demonstrations the report shows in full.
SHOWN = 5


def render_prompt(rows: DataFrame, prompts: list[Prompt]) -> DataFrame:
    """System and user text of every row under each prompt.

    The system text is a literal; it is not joined to the rows.  Each prompt words
    the user text itself.
    """
    variants = F.array(
        *[
            F.struct(
                F.lit(p.task.name).alias("task"),
                F.lit(p.style).alias("style"),
                F.lit(p.system).alias("system_prompt"),
                p.user_column(F.col("symptoms")).alias("user_prompt"),
            )
            for p in prompts
        ]
    )
    return rows.select("example_id", F.explode(variants).alias("v")).select(
        "example_id", "v.task", "v.style", "v.system_prompt", "v.user_prompt"
    )


def label_vocabulary(df: DataFrame, limit: int = MAX_VOCABULARY) -> DataFrame:
    """Distinct labels of a table, sorted and numbered from 1.

    More labels than a closed vocabulary may have make the job fail.
    """
    distinct = df.filter(F.col("diagnosis").isNotNull()).select("diagnosis").distinct().limit(limit + 1)
    packed = distinct.agg(F.array_sort(F.collect_list("diagnosis")).alias("labels"))
    labels = F.when(
        F.size("labels") > limit, F.raise_error(F.lit(f"more than {limit} labels")).cast("array<string>")
    ).otherwise(F.col("labels"))
    return packed.select(F.posexplode(labels).alias("pos", "label")).select(
        (F.col("pos") + 1).alias("ord"),
        "label",
        F.concat((F.col("pos") + 1).cast("string"), F.lit(". "), "label").alias("line"),
    )


def prompt_report(prompt: Prompt, demos: DataFrame, train: DataFrame) -> DataFrame:
    """The report as ordered lines ``(section, ord, text)``.

    ``demos`` is the small table of chosen demonstrations; the sample prompt is
    that of the first training row.
    """
    def line(frame: DataFrame, section: str, order, text) -> DataFrame:
        return frame.select(F.lit(section).alias("section"), order.cast("int").alias("ord"), text.alias("text"))

    about = f"Task: {prompt.task.name}, style: {prompt.style}"
    headings = [(TITLE, 0, about), (INSTRUCTIONS, 0, prompt.instruction_text)]
    fixed = small_frame(demos.sparkSession, headings, "section string, ord int, text string")
    count = demos.agg(F.count(F.lit(1)).alias("n"))
    total = line(count, EXAMPLES, F.lit(0), F.concat(F.lit("Total examples: "), F.col("n").cast("string")))
    entry = F.concat(
        F.concat(F.lit("Example "), F.col("ord").cast("string"), F.lit(" (")), F.col("kind"), F.lit("): "),
        F.col("symptoms"), F.lit(" => "), F.col("diagnosis"),
    )
    shown = line(demos.filter(F.col("ord") <= SHOWN), EXAMPLES, F.col("ord"), entry)
    rest = line(
        count.filter(F.col("n") > SHOWN),
        EXAMPLES,
        F.lit(SHOWN + 1),
        F.concat(F.lit("... and "), (F.col("n") - SHOWN).cast("string"), F.lit(" more examples")),
    )
    sample = line(
        first_n(train, 1), SAMPLE, F.lit(0),
        F.concat(F.lit(prompt.system + "\n\n"), prompt.user_column(F.col("symptoms"))),
    )
    return reduce(DataFrame.unionByName, [fixed, total, shown, rest, sample])
