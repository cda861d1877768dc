"""Scoring sentences by a model: unique keys, a cache, a cap, a scorer, and the results joined back."""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import sqlite3
import time
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.functions.text import strip, without_fences

# Columns, the codes each field may have, and its default.
FIELDS = {
    "rel": ("LLM相关性", 2, 1),
    "time": ("LLM时间指向", 5, 0),
    "voice": ("LLM语态", 3, 0),
    "type": ("LLM句子类型", 7, 0),
    "cert": ("LLM确定性", 3, 1),
    "quant": ("LLM量化属性", 3, 0),
    "tone": ("LLM语气语调", 3, 1),
    "conf": ("LLM置信度", 3, 1),
}
DUAL = {"phys": ("LLM物理分数", 5, 0), "trans": ("LLM转型分数", 5, 0)}
DUAL_NEEDED = ("phys", "trans", "tone", "conf")
STATUS, ERROR = "LLM分析状态", "LLM分析错误"
OK, FAILED, CANCELLED, SKIPPED = "成功", "失败", "已取消", "未分析"
CAP_BATCH = 10_000
MOST_CHARS, CUT_MARK = 500, "…（已截断）"
RATE_RETRIES, RATE_WAIT, RATE_MOST = 40, 5.0, 60.0
UNCHANGED_PROMPT = "fea337e2"


def at_least(value: object, least: int, default: int) -> int:
    """A whole number of at least ``least`` from an option, else the default."""
    try:
        n = int(str(value).strip())
    except ValueError:
        return default
    return n if n >= least else default


@dataclass(frozen=True)
class Scoring:
    """Settings of a run; 0 for ``most`` is no cap."""

    model: str = "model"
    dual: bool = False
    most: int = 0
    prompt: str = ""
    retries: int = 2
    workers: int = 0  # tasks that ask at the same time; 0 leaves it to the plan

    @classmethod
    def from_inputs(cls, given: Mapping[str, object], env: Mapping[str, str] | None = None) -> Scoring:
        """Settings from options or, where they are blank, from LLM_* variables; bad numbers take the default."""
        env = env or {}
        pick = lambda k: str(given.get(k) or env.get(f"LLM_{k.upper()}") or "").strip()
        return cls(pick("model") or cls.model, bool(given.get("dual")), at_least(pick("max_sentences"), 0, cls.most), pick("prompt"), at_least(pick("max_retries"), 1, cls.retries), at_least(pick("workers"), 0, cls.workers))

    @property
    def model_key(self) -> str:
        tag = hashlib.sha1(self.prompt.encode()).hexdigest()[:8]
        return self.model + ("" if not self.prompt or tag == UNCHANGED_PROMPT else f"|{tag}")

    @property
    def fields(self) -> dict[str, tuple[str, int, int]]:
        return {**DUAL, **FIELDS} if self.dual else FIELDS

    @property
    def needed(self) -> tuple[str, ...]:
        return DUAL_NEEDED if self.dual else tuple(FIELDS)


def _json_text(c: Column) -> Column:
    """A JSON string as Python writes it without ASCII escapes."""
    out = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, name in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        out = F.replace(out, F.lit(raw), F.lit(name))
    for i in [*range(0x20)]:
        if chr(i) not in "\n\r\t\b\f":
            out = F.replace(out, F.lit(chr(i)), F.lit(f"\\u{i:04x}"))
    return F.concat(F.lit('"'), out, F.lit('"'))


def record_key(model_key: str) -> Column:
    """SHA-1 of the record as sorted JSON."""
    part = lambda c: _json_text(strip(F.coalesce(F.col(c), F.lit(""))))
    return F.sha1(
        F.concat(F.lit('{"category": '), part("分类"), F.lit(', "keyword": '), part("命中关键词"), F.lit(f', "model": {json.dumps(model_key, ensure_ascii=False)}, "sentence": '), part("命中句子"), F.lit("}")).cast("binary")
    )


def prompt_text() -> Column:
    s = strip(F.coalesce(F.col("命中句子"), F.lit("")))
    s = F.when(F.length(s) > MOST_CHARS, F.concat(F.substring(s, 1, MOST_CHARS), F.lit(CUT_MARK))).otherwise(s)
    given = lambda c: F.when(strip(F.coalesce(F.col(c), F.lit(""))) == "", "未提供").otherwise(strip(F.col(c)))
    return F.concat(F.lit("请分析下列中文年报句子，并按给定 JSON 结构返回结果。\n目标关键词："), given("命中关键词"), F.lit("\n关键词分类："), given("分类"), F.lit("\n句子："), s, F.lit("\n\n只返回 JSON，不要输出任何额外文字。"))


def result_columns(reply: Column, s: Scoring) -> dict[str, Column]:
    """The result columns of a JSON reply: codes outside their range take the default; a missing field fails the row."""
    got = F.from_json(without_fences(reply), "map<string,string>")
    missing = F.array_sort(F.array_except(F.array(*[F.lit(k) for k in s.needed]), F.coalesce(F.map_keys(got), F.array().cast("array<string>"))))
    ok = F.size(missing) == 0

    def code(key: str, size: int, default: Column) -> Column:
        v = got[key].try_cast("double").cast("int")
        return F.when(v.between(0, size - 1), v).otherwise(default)

    out = {column: F.when(ok, code(k, size, F.lit(default))) for k, (column, size, default) in s.fields.items()}
    if s.dual:
        derived = F.when(F.greatest(code("phys", 5, F.lit(0)), code("trans", 5, F.lit(0))) >= 1, 1).otherwise(0)
        out["LLM相关性"] = F.when(ok, code("rel", 2, derived))
    out = {c: (F.coalesce(v, F.lit(-1)) if c not in ("LLM物理分数", "LLM转型分数") else v) for c, v in out.items()}
    text = F.concat(F.lit("LLM返回了空响应或格式不符合预期（缺少字段："), F.array_join(missing, ", "), F.lit("）"))
    return out | {STATUS: F.when(ok, OK).otherwise(FAILED), ERROR: F.when(ok, "").otherwise(text)}


Scorer = Callable[[str], str]


def ask(scorer: Scorer, prompt: str, retries: int, wait: Callable[[float], None] = time.sleep) -> tuple[str | None, str]:
    """(reply, "") or (None, the last error). Rate limits wait longer and are tried more often, and count apart."""
    plain = limited = 0
    while True:
        try:
            reply = scorer(prompt)
            json.loads(reply.replace("```json", "").replace("```", ""))
            return reply, ""
        except Exception as e:  # a scorer may raise anything; the row fails in the end
            text = str(e)
            low = text.lower()
            if "429" in text or "ratelimit" in low or "rate" in low and "limit" in low:
                limited += 1
                if limited > RATE_RETRIES:
                    return None, text[:200]
                wait(min(RATE_MOST, RATE_WAIT * 2 ** (limited - 1)))
            else:
                plain += 1
                if plain >= retries:
                    return None, text[:200]
                wait(float(plain))


def _asked(scorer: Scorer, retries: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [ask(scorer, p, retries) for p in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r for r, _ in got], pa.string()), pa.array([e for _, e in got], pa.string())], ["key", "reply", "failure"])

    return run


def score_hits(hits: DataFrame, scorer: Scorer | Column, s: Scoring, position: str, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``hits`` with the result columns, and the new cache rows (key and results) of successes.

    Each key is asked once.  Keys in the cache with all fields are taken from
    it.  The cap counts the new keys of every CAP_BATCH rows by ``position``,
    in order of first appearance; the rest are marked as skipped.  ``scorer`` is
    a Python callable, run in Arrow batches, or a column that gives the reply.
    """
    keyed = hits.withColumn("_key", record_key(s.model_key))
    columns = [c for c, _, _ in s.fields.values()]
    unique = keyed.groupBy("_key").agg(F.min_by(F.struct("命中关键词", "分类", "命中句子"), position).alias("r"), F.min(position).alias("_first"))
    unique = unique.select("_key", "r.*", "_first").withColumn("_batch", F.floor(F.col("_first") / CAP_BATCH)) if s.most else unique.select("_key", "r.*", "_first")
    if cache is not None:
        needed = [FIELDS[k][0] if k in FIELDS else DUAL[k][0] for k in s.needed]
        whole = F.lit(True)
        for c in needed:
            whole = whole & F.col(c).isNotNull()
        known = cache.filter((F.col(STATUS) == OK) & whole).select(F.col("key").alias("_key"), *columns, STATUS, ERROR)
        unique = unique.join(known.select("_key"), "_key", "left_anti")
    pending, skipped = unique, None
    if s.most:
        # a batch holds at most CAP_BATCH keys, so the window's groups are bounded
        ranked = unique.withColumn("_n", F.row_number().over(Window.partitionBy("_batch").orderBy("_first")))
        pending, skipped = ranked.filter(F.col("_n") <= s.most), ranked.filter(F.col("_n") > s.most)
    asked = pending.select(F.col("_key").alias("key"), prompt_text().alias("prompt"), *([scorer.alias("reply")] if isinstance(scorer, Column) else []))
    if s.workers and not isinstance(scorer, Column):
        asked = asked.repartition(s.workers)
    replies = asked.select("key", "reply", F.lit("").alias("failure")) if isinstance(scorer, Column) else asked.select("key", "prompt").mapInArrow(_asked(scorer, s.retries), "key string, reply string, failure string")
    made = result_columns(F.col("reply"), s)
    made[STATUS] = F.when(F.col("failure") != "", FAILED).otherwise(made[STATUS])
    made[ERROR] = F.when(F.col("failure") != "", F.col("failure")).otherwise(made[ERROR])
    fresh = replies.select(F.col("key").alias("_key"), *[v.alias(c) for c, v in made.items()])
    results = fresh.select("_key", *columns, STATUS, ERROR)
    if skipped is not None:
        results = results.unionByName(skipped.select("_key", *terminal(s, SKIPPED, "超过 LLM 分析上限")))
    if cache is not None:
        results = results.unionByName(known)
    return keyed.join(results, "_key").drop("_key"), fresh.filter(F.col(STATUS) == OK).withColumnRenamed("_key", "key")


def terminal(s: Scoring, status: str, error: str) -> list[Column]:
    """The columns of a row that was not scored."""
    out = [(F.lit(None).cast("int") if c in ("LLM物理分数", "LLM转型分数") else F.lit(-1)).alias(c) for c, _, _ in s.fields.values()]
    return [*out, F.lit(status).alias(STATUS), F.lit(error).alias(ERROR)]


def _cache_table(spark: SparkSession, held: dict[str, object], s: Scoring) -> DataFrame:
    columns = [c for c, _, _ in s.fields.values()]
    rows = [(k, *[v.get(c) for c in columns], v.get(STATUS), v.get(ERROR, "")) for k, v in held.items() if isinstance(v, dict)]
    return spark.createDataFrame(rows, ", ".join(["key string", *[f"`{c}` int" for c in columns], f"`{STATUS}` string", f"`{ERROR}` string"]))


def import_json_cache(spark: SparkSession, path: str, s: Scoring) -> DataFrame:
    """A cache of one JSON object, key to result, as a cache table."""
    with open(path, encoding="utf-8") as f:
        return _cache_table(spark, json.load(f), s)


def load_cache(spark: SparkSession, path: str, s: Scoring) -> DataFrame | None:
    """The cache in an SQLite file of (key, result as JSON), or an older one in JSON; None if there is no file."""
    if not os.path.exists(path):
        return None
    if path.endswith(".json"):
        return import_json_cache(spark, path, s)
    with contextlib.closing(sqlite3.connect(path)) as db:
        held = {k: json.loads(v) for k, v in db.execute("select key, result from cache")}
    return _cache_table(spark, held, s)


def save_cache(fresh: DataFrame, path: str, every: int = 50) -> int:
    """Put new results into an SQLite file, one row a key, a commit every ``every`` rows; gives their number."""
    columns = [c for c in fresh.columns if c != "key"]
    n = 0
    with contextlib.closing(sqlite3.connect(path)) as db:
        db.execute("pragma journal_mode = wal")
        db.execute("create table if not exists cache (key text primary key, result text not null)")
        for row in fresh.toLocalIterator():
            db.execute("insert into cache values (?, ?) on conflict (key) do update set result = excluded.result", (row.key, json.dumps({c: row[c] for c in columns}, ensure_ascii=False)))
            n += 1
            if n % every == 0:
                db.commit()
        db.commit()
    return n


def cost_estimate(most: int) -> str:
    """Tokens a run may take, at 200 to 500 a sentence."""
    return f"{most * 200:,}–{most * 500:,}" if most > 0 else "unbounded"


def by_year(scored: DataFrame, path: str) -> None:
    """Write results by year, a missing year too; years written again replace themselves."""
    scored.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("年份").parquet(path)


def resumed_hits(df: DataFrame) -> DataFrame:
    """A hit table read back for scoring: texts, a year that is no number as 0, without row numbers and older results."""
    kept = [c for c in df.columns if c != "序号" and not c.startswith("LLM")]
    year = F.coalesce(F.col("年份").cast("string").try_cast("double").cast("int"), F.lit(0))
    return df.select(*[year.alias(c) if c == "年份" else F.col(f"`{c}`").cast("string").alias(c) for c in kept])
