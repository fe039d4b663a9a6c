"""Prompts, training rows and a hook for external inference."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Prompt:
    system: str | None
    user: str | None
    assistant: str | None = None


SYSTEM = "You describe source code as a graph of nodes, edges and packages, and answer with that graph alone."
PROMPTS = {
    "diagram": Prompt(SYSTEM, "Code:\n{code}\n\nQuestion: {query}\nDraw all three versions: minimal, medium and full."),
    "diagram_of_version": Prompt(SYSTEM, "Code:\n{code}\n\nQuestion: {query}\nVersion: {version}"),
    "diagram_user_only": Prompt(None, SYSTEM + "\n\nCode:\n{code}\n\nQuestion: {query}\nVersion: {version}"),
    "questions": Prompt(None, "Code:\n{code}\n\nThink in <think>, list questions a newcomer might ask in <candidates>, then give the best one in <final_output>."),
    "continue": Prompt(SYSTEM, "Code:\n{code}\n\nQuestion: {query}", "Go on from where the answer ends."),
}


def rendered(template: str, columns: dict[str, Column], strict: bool = False) -> Column:
    """A template with {fields} as an expression; an unknown field is its name, or an error if strict; nulls print as None."""
    parts = []
    for text, name, _, _ in Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name is not None:
            if name not in columns and strict:
                raise KeyError(name)
            parts.append(F.coalesce(columns[name].cast("string"), F.lit("None")) if name in columns else F.lit(name))
    return F.concat(*parts) if parts else F.lit("")


def messages(prompt: Prompt, columns: dict[str, Column]) -> Column:
    """array<struct<role, content>>; fields are filled in the user's template alone."""
    out = []
    if prompt.system is not None:
        out.append(("system", F.lit(prompt.system)))
    if prompt.user is not None:
        out.append(("user", rendered(prompt.user, columns)))
    if prompt.assistant is not None:
        out.append(("assistant", F.lit(prompt.assistant)))
    return F.array(*[F.struct(F.lit(role).alias("role"), text.alias("content")) for role, text in out])


def sft_rows(df: DataFrame, prompt: Prompt, output: str = "diagram") -> DataFrame:
    """system, instruction, output: a training row for each row; a field that is no column is an error."""
    fields = {c: F.col(c) for c in df.columns}
    return df.select(F.lit(prompt.system).alias("system"), rendered(prompt.user or "", fields, strict=True).alias("instruction"), F.coalesce(F.col(output).cast("string"), F.lit("None")).alias("output"))


@dataclass
class EngineConfig:
    """retries beyond the first try, seconds between them, and what a call may do."""

    retries: int = 3
    retry_after: float = 0.0
    concurrency: int = 8
    follow_up: str | None = None
    extract: Callable[[str], str | None] | None = None
    extract_or_retry: bool = False
    params: dict = field(default_factory=dict)


Complete = Callable[[list[dict], dict], tuple[str, int]]


def answered(complete: Complete, config: EngineConfig, chat: list[dict]) -> tuple[str | None, str | None, int]:
    """(raw answer, extracted answer, tokens) for one chat; (None, None, 0) when every try failed."""
    for attempt in range(config.retries + 1):
        try:
            raw, used = complete(chat, config.params)
            if config.follow_up is not None:
                more, again = complete([*chat, {"role": "assistant", "content": raw}, {"role": "user", "content": config.follow_up}], config.params)
                raw, used = raw + more, used + again
            found = config.extract(raw) if config.extract else None
            if config.extract and found is None and config.extract_or_retry:
                raise ValueError("nothing to extract")
            return raw, found, used
        except Exception:  # noqa: BLE001  whatever the service raises is tried again
            if attempt < config.retries and config.retry_after:
                time.sleep(config.retry_after)
    return None, None, 0


def generated(df: DataFrame, prompt: Prompt, complete: Complete, config: EngineConfig | None = None) -> DataFrame:
    """df with raw_output, extracted_output, total_tokens and output (the extracted one, or else the raw one).

    complete(messages, params) -> (text, tokens) runs on executors, up to concurrency calls at a time in each task.
    """
    config = config or EngineConfig()
    asked = df.withColumn("__chat", messages(prompt, {c: F.col(c) for c in df.columns}))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", raw_output string, extracted_output string, total_tokens long"

    def run(batches: Iterator) -> Iterator:
        from concurrent.futures import ThreadPoolExecutor

        import pyarrow as pa

        with ThreadPoolExecutor(config.concurrency) as pool:
            for batch in batches:
                chats = batch.column(batch.num_columns - 1).to_pylist()
                got = list(pool.map(lambda chat: answered(complete, config, chat), chats))
                new = [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], [*batch.schema.names[:-1], "raw_output", "extracted_output", "total_tokens"])

    return asked.mapInArrow(run, schema).withColumn("output", F.coalesce("extracted_output", "raw_output"))


def last_tag(tags: tuple[str, ...]) -> Callable[[str], str | None]:
    """The extraction of functions.text.tagged_output for one Python string."""

    def extract(text: str) -> str | None:
        for tag in tags:
            _, opened, text = text.rpartition(f"<{tag}>")
            if not opened or f"</{tag}>" not in text:
                return None
        return re.sub(r"\A\s+|\s+\Z", "", text.rpartition(f"</{tags[-1]}>")[0]) or None

    return extract


# Fields of a structured answer, and the versions they stand for.
VERSION_FIELDS = {"minimal_version": "minimal", "medium_version": "medium", "full_version": "full"}


def diagram_rows(df: DataFrame, output: str) -> DataFrame:
    """Answers, Python literals with text_answer and a field for each version, as a row for each version.

    The columns of df but output, then version, diagram, text_answer and output. An answer that can't be read, or
    lacks text_answer, is one row with nulls and its output; rows of answers that can be read have no output.
    """
    from quarrymill.functions.text import null_to_none, strip
    from quarrymill.operators.graph import literal_to_json

    fields = ", ".join(f"{f}: STRING" for f in ("text_answer", *VERSION_FIELDS))
    answer = F.from_json(literal_to_json(null_to_none(strip(F.col(output)))), f"STRUCT<{fields}>")
    rows = df.withColumn("__a", answer)
    failed = F.col("__a")["text_answer"].isNull()
    version = lambda v, d: F.struct(F.lit(v).cast("string").alias("version"), d.cast("string").alias("diagram"))
    each = F.array(*[version(v, F.col("__a")[f]) for f, v in VERSION_FIELDS.items()])
    rows = rows.withColumn("__v", F.explode(F.when(failed, F.array(version(None, F.lit(None)))).otherwise(each)))
    kept = [c for c in df.columns if c != output]
    return rows.select(*kept, "__v.version", "__v.diagram", F.col("__a")["text_answer"].alias("text_answer"), F.when(failed, F.col(output)).alias("output"))


def question_rows(df: DataFrame, stratum: str, key: str, n: int, seed: int, prompt: Prompt, complete: Complete, config: EngineConfig) -> DataFrame:
    """A sample of df in proportion to strata, with user_queries (extracted from the answer) and generated_output (the whole answer)."""
    from quarrymill.operators.curate import quota_sample

    rows = generated(quota_sample(df, stratum, key, n, seed), prompt, complete, config)
    return rows.select(*df.columns, F.col("extracted_output").alias("user_queries"), F.col("raw_output").alias("generated_output"))
