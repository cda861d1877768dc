"""The command line: resume, scoring over HTTP, and input it refuses."""

import csv
import json
import os
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from termloom import cli
from termloom.operators.http_scorer import HttpScorer, reply_schema
from termloom.operators.scoring import Scoring, at_least, load_cache, save_cache

BODY = "公司坚持绿色发展并且持续投入环境治理。本年度我们继续推进生态保护工作。"


class Endpoint(BaseHTTPRequestHandler):
    asked: list = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Endpoint.asked.append(body)
        if body["response_format"]["type"] == "json_schema" and body["model"] == "old":
            self.send_response(400)
            self.end_headers()
            return
        keys = ("phys", "trans", "tone", "conf") if "rubric" in str(body["messages"][0]) else ("rel", "time", "voice", "type", "cert", "quant", "tone", "conf")
        text = json.dumps(dict.fromkeys(keys, 1))
        raw = json.dumps({"choices": [{"message": {"content": text}}]}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(raw)

    def log_message(self, *a):
        pass


@pytest.fixture()
def endpoint():
    Endpoint.asked.clear()
    server = HTTPServer(("127.0.0.1", 0), Endpoint)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


@pytest.fixture()
def inputs(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        (folder / f"00000{i + 1}_202{i}_x.txt").write_text(BODY, encoding="utf-8")
    (tmp_path / "d.txt").write_text("环境：绿色,环境", encoding="utf-8")
    return tmp_path


def run(base, *more):
    return cli.main(["analyse", "--data-dir", str(base / "in"), "--dict", str(base / "d.txt"), "--output", str(base / "out.xlsx"), *more])


def rows(path):
    with open(path, encoding="utf-8-sig", newline="") as f:
        return list(csv.DictReader(f))


def test_old_workbooks_and_files_without_roles(spark, inputs):
    (inputs / "in" / "bad.csv").write_text("a,b\n1,2\n", encoding="utf-8")
    assert run(inputs) == 0
    from termloom.sources.xlsx import Workbook

    with Workbook(str(inputs / "out.xlsx")) as book:
        text = str([list(book.rows(s)) for s in book.sheets()])
        assert "缺少公司代码列" in text and "完成（含异常）" in text and "SHA256" in text
    (inputs / "in" / "x.xls").write_bytes(b"old")
    assert run(inputs) == 2


def test_an_interrupted_run_goes_on(spark, inputs, monkeypatch):
    monkeypatch.setattr(cli, "FILES_A_BATCH", 1)
    read, load = [], cli.load_records

    def once(spark, files):
        read.append(files)
        if len(read) == 3:
            raise RuntimeError("lost")
        return load(spark, files)

    monkeypatch.setattr(cli, "load_records", once)
    assert run(inputs, "--export-sentences") == 1
    assert len(list((inputs / "out_checkpoint").glob("*/done-*.json"))) == 2
    read.clear()
    monkeypatch.setattr(cli, "load_records", lambda spark, files: read.append(files) or load(spark, files))
    assert run(inputs, "--export-sentences") == 0
    assert [len(f) for f in read] == [1, 3] and not (inputs / "out_checkpoint").exists()
    assert len(rows(inputs / "out_命中句子.csv")) == 6


def test_scoring_over_http(spark, inputs, endpoint):
    args = ["--llm-api-key", "k", "--llm-base-url", endpoint, "--llm-cache", str(inputs / "cache.db"), "--llm-model", "old"]
    assert run(inputs, *args) == 0
    found = rows(inputs / "out_命中句子.csv")
    assert len(found) == 6 and {r["LLM分析状态"] for r in found} == {"成功"}
    assert len(Endpoint.asked) == 4  # two keys, each once more without a schema
    assert cli.main(["analyse", "--data-dir", "x", "--dict", "x", "--output", str(inputs / "again.xlsx"), "--resume-sentences", str(inputs / "out_命中句子.csv"), *args]) == 0
    assert len(Endpoint.asked) == 4 and len(rows(inputs / "again_命中句子.csv")) == 6
    (inputs / "r.md").write_text("rubric", encoding="utf-8")
    dual = ["score", "--sentences", str(inputs / "out_命中句子.csv"), "--out", str(inputs / "dual.csv"), "--cache", str(inputs / "dual.db"), "--rubric", str(inputs / "r.md"), "--api-key", "k", "--base-url", endpoint]
    assert cli.main(dual) == 0
    assert {(r["LLM物理分数"], r["LLM相关性"]) for r in rows(inputs / "dual.csv")} == {("1", "1")} and sorted(os.listdir(inputs / "dual_years"))[-1].startswith("年份=2022")
    assert run(inputs, "--llm-api-key", "k") == 2


def test_settings_and_cache(spark, tmp_path):
    assert (at_least("7", 1, 2), at_least("x", 1, 2), at_least("0", 1, 2), at_least(None, 0, 3)) == (7, 2, 2, 3)
    s = Scoring.from_inputs({"model": "", "max_sentences": "-1"}, {"LLM_MODEL": "m", "LLM_MAX_RETRIES": "5"})
    assert (s.model, s.most, s.retries) == ("m", 0, 5)
    assert set(reply_schema(Scoring(dual=True))["required"]) == {"phys", "trans", "tone", "conf"}
    assert HttpScorer(s, "u/", "k").url == "u/"
    columns = [c for c, _, _ in s.fields.values()]
    kind = ", ".join(["key string", *[f"`{c}` int" for c in columns], "`LLM分析状态` string", "`LLM分析错误` string"])
    path = str(tmp_path / "c.db")
    assert load_cache(spark, path, s) is None
    for value in (1, 2):
        assert save_cache(spark.createDataFrame([(f"k{i}", *[value] * len(columns), "成功", "") for i in range(3)], kind), path, 2) == 3
    held = load_cache(spark, path, s).collect()
    assert len(held) == 3 and {r[columns[0]] for r in held} == {2}
