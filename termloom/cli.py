"""Command line: one program for each pipeline, all on a Spark session.

Exit codes: 0 done, 1 failed, 2 bad input, 130 interrupted.
"""

from __future__ import annotations

import argparse
import logging
import os
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


LOG = logging.getLogger("termloom")
#: Files whose results are written down together, so that an interrupted run goes on after them.
FILES_A_BATCH = 5000


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="termloom")
    sub = p.add_subparsers(dest="program", required=True)

    a = sub.add_parser("analyse", help="records to panels, quality, issues and hits")
    a.add_argument("--data-dir", action="append", required=True)
    a.add_argument("--dict", action="append", required=True)
    a.add_argument("--output", required=True)
    a.add_argument("--col-stkcd", default="公司代码")
    a.add_argument("--col-year", default="年份")
    a.add_argument("--col-text", action="append")
    a.add_argument("--workers", type=int, default=4)
    a.add_argument("--no-regex", action="store_true", help="count whole tokens")
    a.add_argument("--export-sentences", action="store_true")
    a.add_argument("--aggregate-year", action="store_true")
    a.add_argument("--aggregation", choices=("raw", "monthly", "yearly"))
    a.add_argument("--retain-column", action="append", default=[])
    a.add_argument("--use-tf", action="store_true", help="add shares")
    a.add_argument("--jieba-userdict")
    a.add_argument("--llm-api-key")
    a.add_argument("--llm-model", default="model")
    a.add_argument("--llm-base-url")
    a.add_argument("--llm-max-sentences", type=int, default=0)
    a.add_argument("--llm-workers", type=int, default=16, help="requests at a time")
    a.add_argument("--llm-max-retries", type=int, default=2)
    a.add_argument("--llm-cache")
    a.add_argument("--llm-system-prompt-file")
    a.add_argument("--resume-sentences")
    a.add_argument("--log-file")
    a.add_argument("--restart", action="store_true", help="forget what an interrupted run has done")

    e = sub.add_parser("extract", help="sections out of long reports")
    e.add_argument("--src-root", required=True)
    e.add_argument("--out-root", required=True)
    e.add_argument("--start", type=int, default=0)
    e.add_argument("--limit", type=int, default=0)
    e.add_argument("--index-output")

    c = sub.add_parser("count-sentences", help="sentence counts of extracted sections")
    c.add_argument("--src-root", required=True)
    c.add_argument("--output", required=True)
    c.add_argument("--excel-output")
    c.add_argument("--limit", type=int, default=0)

    k = sub.add_parser("count-terms", help="term panel and hit table of a corpus")
    k.add_argument("--mda-root", required=True)
    k.add_argument("--dict", required=True)
    k.add_argument("--outdir", required=True)
    k.add_argument("--procs", type=int, default=4)

    d = sub.add_parser("score", help="dual scoring of a hit table, by year")
    d.add_argument("--sentences", required=True)
    d.add_argument("--out", required=True)
    d.add_argument("--cache", required=True)
    d.add_argument("--rubric")
    d.add_argument("--api-key")
    d.add_argument("--base-url")
    d.add_argument("--max-sentences", type=int, default=0)
    d.add_argument("--model", default="model")
    d.add_argument("--workers", type=int, default=8, help="requests at a time")
    for name, default in (("year", "年份"), ("keyword", "命中关键词"), ("category", "分类"), ("sentence", "命中句子")):
        d.add_argument(f"--col-{name}", default=default)

    w = sub.add_parser("panel", help="wide company-year panel of scores")
    w.add_argument("--scores", required=True)
    w.add_argument("--wordfreq-panel", required=True)
    w.add_argument("--dict", required=True)
    w.add_argument("--outdir", required=True)
    w.add_argument("--stata-version", type=int, default=15)

    r = sub.add_parser("ratios", help="ratios over sentence counts")
    r.add_argument("--risk-input", required=True)
    r.add_argument("--sentence-input", required=True)
    r.add_argument("--output-dta", required=True)
    r.add_argument("--output-csv")
    r.add_argument("--issues-output")
    return p


class BadInput(Exception):
    pass


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, CSV or spreadsheet as texts, without the helper columns."""
    from termloom.sources.csv import read_csv
    from termloom.sources.xlsx import SheetSource

    if path.endswith(".csv"):
        return read_csv(spark, path).drop("__file", "__row")
    if path.endswith(".xlsx"):
        spark.dataSource.register(SheetSource)
        return spark.read.format("sheet").load(path).drop("__file", "__row")
    return spark.read.parquet(path)


def input_files(folders: list[str], output: str) -> list[str]:
    from termloom.sources.files import data_files, without_outputs

    files = without_outputs(data_files(folders)[0], output)
    old = [f for f in files if f.lower().endswith(".xls")]
    if old:
        raise BadInput(f"old .xls workbooks cannot be read, save them as .xlsx or CSV: {', '.join(old[:5])}")
    if not files:
        raise BadInput("no data files")
    return files


def load_records(spark: SparkSession, files: list[str]) -> DataFrame:
    """Data files as one frame of texts; columns a file lacks are null. One plan branch for each kind of file and header."""
    import json
    from functools import reduce

    from termloom.sources.csv import csv_header, probe, read_csv
    from termloom.sources.files import text_records
    from termloom.sources.xlsx import SheetSource

    by = {s: [f for f in files if f.lower().endswith(s)] for s in (".xlsx", ".csv", ".txt")}
    parts = []
    if by[".xlsx"]:
        spark.dataSource.register(SheetSource)
        parts.append(spark.read.format("sheet").option("paths", json.dumps(by[".xlsx"])).load())
    alike: dict[tuple, list[str]] = {}
    for f in by[".csv"]:
        found = probe(f)
        alike.setdefault((*found, *csv_header(f, found)), []).append(f)
    parts += [read_csv(spark, group, key[0], key[1]) for key, group in alike.items()]
    parts += [text_records(spark, by[".txt"])] if by[".txt"] else []
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def scorer_of(o: argparse.Namespace, s, key: str | None, url: str | None):
    """The HTTP scorer of the options, or of the LLM_* variables where they are blank."""
    from termloom.operators.http_scorer import HttpScorer

    key, url = key or os.environ.get("LLM_API_KEY"), url or os.environ.get("LLM_BASE_URL")
    if not key or not url:
        raise BadInput("scoring needs a key and a base URL")
    return HttpScorer(s, url, key)


def score_and_write(spark: SparkSession, rows: DataFrame, s, scorer, cache_path: str | None, stem: str) -> None:
    """Score a hit table, keep the new results in the cache, and write the table beside the output."""
    from termloom.operators.scoring import load_cache, save_cache, score_hits
    from termloom.session import stage
    from termloom.sources.csv import write_csv
    from termloom.sources.sinks import write_sheets

    placed = rows if "序号" in rows.columns else rows.withColumn("序号", F.monotonically_increasing_id())
    cache = load_cache(spark, cache_path, s) if cache_path else None
    out, fresh = score_hits(placed, scorer, s, "序号", cache)
    out = stage(out)  # the scorer is asked once
    if cache_path:
        from termloom.operators.scoring import ERROR, OK, STATUS, record_key

        known = [c for c in fresh.columns if c != "key"]
        save_cache(out.filter(F.col(STATUS) == OK).select(record_key(s.model_key).alias("key"), *known).dropDuplicates(["key"]), cache_path)
        print(f"{ERROR}: {out.filter(F.col(STATUS) != OK).count()}", file=sys.stderr)
    final = out.orderBy("序号")
    write_csv(final, f"{stem}.csv")
    write_sheets(f"{stem}.xlsx", {"命中句子": final})


def analyse(spark: SparkSession, o: argparse.Namespace) -> None:
    import json
    import shutil

    from termloom.operators.dictionary import Dictionary
    from termloom.operators.match import longest_match
    from termloom.operators.scoring import Scoring, cost_estimate, resumed_hits
    from termloom.plans.analysis import Analysis, Spec, lacking_roles, numbered
    from termloom.sources.csv import write_csv
    from termloom.sources.files import binary, listed, manifest, pending, read_header
    from termloom.sources.sinks import write_sheets
    from termloom.streaming.files import signature

    stem = str(Path(o.output).with_suffix("")) + "_命中句子"
    prompt = Path(o.llm_system_prompt_file).read_text(encoding="utf-8") if o.llm_system_prompt_file else ""
    wanted = bool(o.llm_api_key or o.llm_base_url)
    settings = Scoring.from_inputs({"model": o.llm_model, "max_sentences": o.llm_max_sentences, "max_retries": o.llm_max_retries, "prompt": prompt, "workers": o.llm_workers}, os.environ)
    if o.resume_sentences:  # only score an earlier hit table
        rows = resumed_hits(load_table(spark, o.resume_sentences))
        score_and_write(spark, rows, settings, scorer_of(o, settings, o.llm_api_key, o.llm_base_url), o.llm_cache, stem)
        return
    words = Dictionary()
    for path in o.dict:
        words.import_file(path)
    if not words.keywords():
        raise BadInput("the dictionary is empty")
    own = [line.split()[0] for line in Path(o.jieba_userdict).read_text(encoding="utf-8").splitlines() if line.split()] if o.jieba_userdict else []
    mode = "yearly" if o.aggregate_year else o.aggregation or "raw"
    spec = Spec(o.col_stkcd, o.col_year, tuple(o.col_text or ["文本内容"]), mode, tuple(o.retain_column), o.use_tf, o.no_regex, tokenizer=longest_match([*words.keywords(), *own]) if o.no_regex else None)
    files = input_files(o.data_dir, o.output)
    headers = {}
    statuses = {}
    for i, f in enumerate(files, 1):
        try:
            headers[f] = read_header(f)
        except (OSError, ValueError, KeyError) as e:
            statuses[f] = f"读取失败：{e}"
        LOG.info("headers %d/%d", i, len(files))
    statuses |= lacking_roles(headers, spec)
    good = [f for f in files if f not in statuses]
    if not good:
        raise BadInput("no file could be processed")
    # what an interrupted run of the same files and settings has done is kept in this folder
    stats = [(f, os.stat(f).st_size, os.stat(f).st_mtime) for f in good]
    asked = {k: v for k, v in vars(spec).items() if k != "tokenizer"} | {"dictionary": words.fingerprint(), "own": own}
    folder = Path(o.output).with_name(f"{Path(o.output).stem}_checkpoint")
    place = folder / signature(stats, asked)
    if o.restart:
        shutil.rmtree(folder, ignore_errors=True)
    finished = [json.loads(p.read_text(encoding="utf-8")) for p in sorted(place.glob("done-*.json"))]
    done = [f for part in finished for f in part]
    todo = [r.path for r in pending(listed(spark, good), listed(spark, done) if done else None).orderBy("pos").toLocalIterator()]
    for k in range(0, len(todo), FILES_A_BATCH):
        part = todo[k : k + FILES_A_BATCH]
        number = len(finished) + k // FILES_A_BATCH
        Analysis(load_records(spark, part), words, spec).facts.write.mode("overwrite").parquet(str(place / f"facts-{number}"))
        (place / f"done-{number}.json").write_text(json.dumps(part), encoding="utf-8")
        LOG.info("files %d/%d", len(done) + k + len(part), len(good))
    run = Analysis(load_records(spark, good), words, spec, statuses, manifest(binary(spark, files)))
    run.hold(spark.read.parquet(*[str(p) for p in sorted(place.glob("facts-*"))]))
    write_sheets(o.output, run.sheets())
    if o.export_sentences or wanted:
        rows = numbered(run.hits, "公司代码", "年份", "分类", "命中关键词", "命中句子")
        if wanted:
            LOG.info("tokens: %s", cost_estimate(settings.most))
            score_and_write(spark, rows, settings, scorer_of(o, settings, o.llm_api_key, o.llm_base_url), o.llm_cache, stem)
        else:
            write_csv(rows, f"{stem}.csv")
            write_sheets(f"{stem}.xlsx", {"命中句子": rows})
    shutil.rmtree(folder, ignore_errors=True)


def extract(spark: SparkSession, o: argparse.Namespace) -> None:
    from termloom.functions.fields import report_meta
    from termloom.operators.section import extract_sections, structured_text
    from termloom.sources.csv import write_csv
    from termloom.sources.files import best_decoding, binary, data_files, decoded
    from termloom.sources.sinks import write_texts

    src, out = Path(o.src_root).resolve(), Path(o.out_root).resolve()
    if src == out:
        raise BadInput("the output folder must not be the source folder")
    files = sorted(f for f in data_files([str(src)], (".txt",))[0] if out not in Path(f).resolve().parents)
    files = files[o.start : o.start + o.limit if o.limit else None]
    if not files:
        raise BadInput("no files in that range")
    rel = F.substring(F.url_decode(F.regexp_replace("path", "^file:/+", "/")), F.lit(len(str(src)) + 2), F.lit(1 << 20))
    texts = decoded(binary(spark, files), best_decoding).withColumn("source", rel).withColumn("stem", F.regexp_extract("source", r"([^/]+)\.[^./]*$", 1))
    found = extract_sections(texts)
    write_texts(found.withColumn("body", structured_text(found)).withColumn("relative", F.col("source")), str(out)).count()
    m = report_meta(F.col("stem"))
    index = found.select(
        m["code"].alias("公司代码"), m["year"].alias("年份"), m["company"].alias("公司名称"), m["title"].alias("报告标题"), m["date"].alias("报告日期"),
        F.col("source").alias("source_file"), F.col("source").alias("output_file"), F.col("encoding").alias("source_encoding"), "status", "message", F.col("section_chars").alias("mda_chars"),
    )
    write_csv(index.orderBy("source_file"), o.index_output or str(out / "mda_index.csv"))


def count_sentences(spark: SparkSession, o: argparse.Namespace) -> None:
    from functools import partial

    from termloom.operators.section import sentence_counts
    from termloom.sources.csv import write_csv
    from termloom.sources.files import best_decoding, binary, data_files, decoded
    from termloom.sources.sinks import write_sheets

    files = sorted(data_files([o.src_root], (".txt",))[0])[: o.limit or None]
    if not files:
        raise BadInput("no files")
    root = len(str(Path(o.src_root).resolve())) + 2
    rel = F.substring(F.url_decode(F.regexp_replace("path", "^file:/+", "/")), F.lit(root), F.lit(1 << 20))
    t = decoded(binary(spark, [str(Path(f).resolve()) for f in files]), partial(best_decoding, prefer_utf8=True, sample=200_000)).withColumn("source", rel)
    rows = sentence_counts(t.withColumn("stem", F.regexp_extract("source", r"([^/]+)\.[^./]*$", 1))).orderBy("年份", "公司代码", "来源文件")
    write_csv(rows, o.output)
    if o.excel_output:
        write_sheets(o.excel_output, {"MDA句子数": rows})


def count_terms(spark: SparkSession, o: argparse.Namespace) -> None:
    from termloom.operators.dictionary import read_tiered
    from termloom.operators.panel import hit_table, keyword_panel, report_sentences, term_hits
    from termloom.sources.files import binary, lenient
    from termloom.sources.sinks import write_sheets

    terms = read_tiered(spark, o.dict)
    files = binary(spark, o.mda_root, "*.txt")
    stem = F.url_decode(F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1))
    cut = report_sentences(files.select(stem.alias("stem"), lenient(F.col("content")).alias("text")))
    found = term_hits(cut, terms)
    write_sheets(str(Path(o.outdir) / "命中句明细.xlsx"), {"Sheet1": hit_table(found)})
    write_sheets(str(Path(o.outdir) / "公司年份面板.xlsx"), {"Sheet1": keyword_panel(cut, found, terms).orderBy("公司代码", "年份")})


def score(spark: SparkSession, o: argparse.Namespace) -> None:
    """Dual scoring of a hit table, year by year; a year is written before the next is asked for."""
    from termloom.operators.scoring import STATUS, Scoring, by_year, load_cache, save_cache, score_hits
    from termloom.session import stage
    from termloom.sources.csv import write_csv

    prompt = Path(o.rubric).read_text(encoding="utf-8") if o.rubric else ""
    s = Scoring.from_inputs({"model": o.model, "dual": True, "prompt": prompt, "max_sentences": o.max_sentences, "workers": o.workers}, os.environ)
    scorer = scorer_of(o, s, o.api_key, o.base_url)
    names = {o.col_year: "年份", o.col_keyword: "命中关键词", o.col_category: "分类", o.col_sentence: "命中句子"}
    table = load_table(spark, o.sentences).withColumnsRenamed(names)
    table = table.drop("序号", *[c for c in table.columns if c.startswith("LLM")])  # what an earlier run has added
    rows = stage(table.withColumn("_pos", F.monotonically_increasing_id()))
    shards = str(Path(o.out).with_suffix("")) + "_years"
    years = [r["年份"] for r in rows.select("年份").distinct().orderBy("年份").toLocalIterator()]
    for year in years:
        out, fresh = score_hits(rows.filter(F.col("年份").eqNullSafe(F.lit(year))), scorer, s, "_pos", load_cache(spark, o.cache, s))
        out, known = stage(out), [c for c in fresh.columns if c != "key"]
        from termloom.operators.scoring import OK, record_key

        save_cache(out.filter(F.col(STATUS) == OK).select(record_key(s.model_key).alias("key"), *known).dropDuplicates(["key"]), o.cache)
        by_year(out, shards)
        LOG.info("year %s: %d rows", year, out.count())
    write_csv(spark.read.parquet(shards).orderBy("_pos").drop("_pos"), o.out)


def panel(spark: SparkSession, o: argparse.Namespace) -> None:
    from termloom.operators.dictionary import read_tiered
    from termloom.operators.panel import score_panel
    from termloom.sources.csv import write_csv
    from termloom.sources.sinks import label_table, write_sheets, write_stata

    terms = read_tiered(spark, o.dict, drop_missing=False)
    out = score_panel(load_table(spark, o.wordfreq_panel), load_table(spark, o.scores), terms).orderBy("code", "year")
    labels = {"code": "股票代码（6位）", "year": "报告年份", "hit_sent": "词典命中的句子数（去重，不论得分）"}
    write_csv(out, str(Path(o.outdir) / "panel.csv"))
    write_stata(out, str(Path(o.outdir) / "panel.dta"), labels, o.stata_version)
    write_sheets(str(Path(o.outdir) / "labels.xlsx"), {"变量标签": label_table(spark, labels), "词条对应": terms.select("var", "term", "tier", "tier_name")})


def ratios(spark: SparkSession, o: argparse.Namespace) -> None:
    from termloom.operators.ratios import issues, labels, recalculate, sentence_panel
    from termloom.sources.csv import write_csv
    from termloom.sources.sinks import read_stata, write_stata

    risk, given = read_stata(spark, o.risk_input)
    out = recalculate(risk, sentence_panel(load_table(spark, o.sentence_input)))
    write_stata(out, o.output_dta, labels(given, out.columns))
    if o.output_csv:
        write_csv(out, o.output_csv)
    if o.issues_output:
        write_csv(issues(out), o.issues_output)


PROGRAMS = {"analyse": analyse, "extract": extract, "count-sentences": count_sentences, "count-terms": count_terms, "score": score, "panel": panel, "ratios": ratios}


def main(argv: list[str] | None = None) -> int:
    from termloom.session import ship

    o = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s", filename=getattr(o, "log_file", None), force=True)
    build = SparkSession.builder.config("spark.sql.session.timeZone", "UTC")
    tasks = getattr(o, "procs", None) or (o.workers if o.program == "analyse" else None)
    if tasks and not ("PYSPARK_GATEWAY_PORT" in os.environ or "--master" in os.environ.get("PYSPARK_SUBMIT_ARGS", "")):
        build = build.master(f"local[{tasks}]")  # what was submitted to a cluster goes by its settings
    spark = ship(build.getOrCreate())
    try:
        PROGRAMS[o.program](spark, o)
    except KeyboardInterrupt:
        spark.sparkContext.cancelAllJobs()
        return 130
    except (BadInput, FileNotFoundError, ValueError) as e:
        print(e, file=sys.stderr)
        return 2
    except Exception as e:  # whatever else went wrong is a failed run
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
