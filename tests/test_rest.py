import datetime as dt
import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from shelfmark.operators import catalog as C, dialogue as D, evaluation as E, planning as P, versions as V
from shelfmark.sources import files as S
from shelfmark.streaming import sync as Y

DOC = "doc_id string, title string, collection string, source string, pages int, added_at timestamp_ntz"
T0 = dt.datetime(2024, 5, 1)


def test_questions(spark):
    lines = ["# comment", "", "最高温度 | qt310-guide.pdf p.1", "仲裁 优先级 | qt310-guide.pdf p2； CAN 总线仲裁踩坑", "a | b | Guide.PDF", "天气 | -", "nothing after", "| nothing before"]
    df = spark.createDataFrame([(i + 1, t) for i, t in enumerate(lines)], "line int, text string")
    rows = E.parse_questions(df).orderBy("line").collect()
    good = [(r["line"], r["question"], [(e["doc"], e["page"]) for e in r["expected"]]) for r in rows if not r["bad"]]
    assert good == [
        (3, "最高温度", [("qt310-guide.pdf", 1)]), (4, "仲裁 优先级", [("qt310-guide.pdf", 2), ("CAN 总线仲裁踩坑", None)]),
        (5, "a | b", [("Guide.PDF", None)]), (6, "天气", []),
    ]
    assert [r["line"] for r in rows if r["bad"]] == [7, 8]


def test_metrics(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    gold = spark.createDataFrame([(1, "qt310", 2), (2, "k-9", None)], "query_id long, doc string, page int")
    hits = spark.createDataFrame(
        [("keyword", 1, 1, "k-1", "QT310-Guide.pdf", 1), ("keyword", 1, 2, "k-1", "QT310-Guide.pdf", 2)],
        "mode string, query_id long, rank long, doc_id string, title string, page int",
    )
    ranked = E.ranks(q, gold, hits, ["keyword"])
    m = E.metrics(ranked).first().asDict()
    assert m == {"mode": "keyword", "answerable": 2, "hit1": 0, "hit3": 1, "hit8": 1, "mrr": 0.25, "unanswerable": 1, "quiet": 1}
    assert E.summary(E.metrics(ranked)).first().asDict() == {"mode": "keyword", "hit1": "0%", "hit3": "50%", "hit8": "50%", "mrr": "0.25", "quiet": "100%"}
    assert {r["said"] for r in E.detail_rows(ranked).collect()} == {"#2", "not found", "empty"}


def test_shell_writes(one):
    writes = ["sed -i 's/x/y/' m.py", "echo hi > out.log", "ls | tee list", "cp m n", "perl -pi -e 's/x/y/' m", "p.write_text(x)"]
    reads = ["make all 2>&1", "ls -la", "grep -n y m.py", "python t.py >/dev/null"]
    assert all(one({"c": w}, D.shell_writes("c")) for w in writes) and not any(one({"c": r}, D.shell_writes("c")) for r in reads)


MSG = "conv_id long, turn long, role string, text string, tool string, call_id string, is_error boolean, arguments string, kind string"


def run_of(*steps):
    rows = []
    for i, s in enumerate(steps):
        what, *x = s.split("|")
        blank = [None] * 6
        if what == "user":
            rows.append((i, "user", x[0], *blank[:5], None))
        elif what == "call":
            rows.append((i, "assistant", "", x[0], x[1] if len(x) > 1 else None, None, x[2] if len(x) > 2 else "{}", None, None))
        elif what in ("ok", "fail"):
            rows.append((i, "toolResult", "", x[0], x[1] if len(x) > 1 else None, what == "fail", None, None, None))
        else:
            rows.append((i, "custom", "", None, None, None, None, "reminder", None))
    return [r[:8] for r in rows]


def test_nudges(spark):
    runs = {
        "debugged": [
            run_of("user|fix", "fail|bash", "ok|read", "ok|write"),
            run_of("user|fix", "fail|bash|1", "call|bash|2|sed -i x f", "ok|bash|2"),
        ],
        "told": [run_of("user|From now on use tabs"), run_of("user|以后用空格", "fail|bash")],
        None: [
            run_of("user|rename", "ok|edit"), run_of("user|x", "ok|edit", "fail|bash"), run_of("user|fix", "fail|bash", "ok|edit", "user|thanks"),
            run_of("user|fix", "fail|bash", "ok|edit", "call|save_note"), run_of("user|fix", "fail|bash", "ok|edit", "custom"),
            run_of("user|fix", "fail|bash", "call|notes_find|3|echo x > f", "ok|notes_find|3"), run_of("user|fix", "fail|bash", "call|bash|4|ls 2>&1", "ok|bash|4"),
        ],
    }
    rows, want = [], {}
    for reason, group in runs.items():
        for messages in group:
            conv = len(want)
            want[conv] = reason
            rows += [(conv, *m) for m in messages]
    got = {r["conv_id"]: r["reason"] for r in D.note_nudges(spark.createDataFrame(rows, MSG), "save_note", "notes_", "reminder").collect()}
    assert got == {k: v for k, v in want.items() if v}


def test_planned_searches_and_citations(one):
    reply = 'thinking {"queries": [" spi  clock ", 7, "", "a", "b", "c", "d"]} end'
    assert one({"r": reply}, P.parse_searches("r", F.lit("q"))) == ["q", "spi clock", "a", "b", "c"]
    assert one({"r": "no json"}, P.parse_searches("r", F.lit("q"))) == ["q"]
    assert one({"a": "x [3] y [1, 9] z [3]"}, P.cited_numbers("a", 8)) == [3, 1]
    assert one({"a": "x [3] y [1, 9] z [12]"}, P.renumber("a", 8)) == "x [1] y [2] z "


def test_answer_prompt():
    rows = [{"n": 1, "title": "m.pdf", "page": 2, "heading": "H", "unreviewed": True, "text": "T"}]
    said = P.answer_question(lambda system, text, limit: f"{limit}:{text}", "", "q?", rows, ["NX-9"])
    assert "[1] m.pdf p.2 § H (unreviewed note)\nT" in said and "NX-9" in said and said.startswith("1500:")
    assert P.answer_question(lambda *a: "never", "", "q", [], []) == ""


def test_versions_and_titles(spark):
    docs = spark.createDataFrame(
        [(1, "/a/alpha/README.md"), (2, "/a/beta/README.md"), (3, "upload:README.md"), (4, "upload:README.md"), (5, "/x/one.md"), (6, "/x/one.md")],
        "doc_id long, source string",
    )
    got = {r["doc_id"]: r["title"] for r in V.distinct_titles(docs).collect()}
    assert got == {1: "alpha/README.md", 2: "beta/README.md", 3: "README.md", 4: "README.md (2)", 5: "one.md", 6: "one.md (2)"}
    again = {r["doc_id"]: r["title"] for r in V.distinct_titles(docs, F.floor(F.col("doc_id") / 2)).collect()}
    assert again == got
    old = docs.withColumn("title", F.col("doc_id").cast("string")).withColumn("added_at", F.col("doc_id"))
    files = spark.createDataFrame([(10, "/x/one.md"), (11, "upload:README.md"), (12, "/b/README.md"), (13, "/b/new.md")], "file_id long, source string")
    found = {r["file_id"]: (r["versions"], r["first_title"], r["last_id"]) for r in V.previous_versions(files, old).collect()}
    assert found == {10: (2, "5", 6), 11: (4, "1", 4), 12: (2, "3", 4)}


def test_listing(spark):
    rows = [(f"k{i}", f"d{i}.pdf", "docs", f"/x/{'boards' if i < 5 else 'sensors'}/d{i}.pdf", 12, T0) for i in range(7)]
    docs = spark.createDataFrame(rows + [("w1", "CAN", "wiki", "wiki/spi.md", None, T0)], DOC)
    assert [r["title"] for r in C.list_page(docs, offset=6).collect()] == ["d6.pdf", "CAN"]
    assert C.list_header(docs, offset=0, limit=3).first().asDict() == {"docs": 7, "notes": 1, "first": 1, "last": 3, "rest": 5}
    groups = C.top_groups(docs.withColumn("f", C.folder_of("source")), "f").collect()
    assert [(r["name"], r["n"]) for r in groups] == [("boards", 5), ("sensors", 2)]
    assert C.matching(docs, " Sensors ").count() == 2
    assert [r["doc_id"] for r in C.match_docs(docs, "K3").collect()] == ["k3"]
    assert C.match_docs(docs, "  ").count() == 8
    shelves = spark.createDataFrame([("k1", "A"), ("k2", "a"), ("k3", "B")], "doc_id string, shelf string")
    assert C.visible(docs, shelves, only="a").count() == 2
    assert C.visible(docs, shelves, any_of=[]).count() == 5 and C.visible(docs, shelves, any_of=["b"]).count() == 6
    assert C.stats(docs).first().asDict() == {"docs": 7, "wiki": 1, "pages": 84}


def test_sources(spark, tmp_path):
    root = tmp_path / "in"
    for name, text in {"a.md": "# A\r\nx", "s/b.html": "<p>Hi&amp;</p>", "c.exe": "x", ".hid/d.md": "x", "node_modules/e.md": "x", "log.md": "x"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(text.encode())
    found = S.scan_files(spark, str(root))
    assert sorted(os.path.basename(r["path"]) for r in found.select("path").collect()) == ["a.md", "b.html", "log.md"]
    assert {r["markdown"] for r in S.read_texts(found).collect()} == {"# A\nx", "Hi&", "x"}
    assert {r["path"] for r in S.scan_notes(spark, str(root)).collect()} == {"a.md", "node_modules/e.md"}
    shelf = tmp_path / "docs"
    shelf.mkdir()
    (shelf / "k-1.json").write_text(json.dumps({"id": "k-1", "path": "p", "title": "T"}, indent=2))
    (shelf / "k-2.json").write_text(json.dumps({"id": "k-9", "path": "p"}))
    (shelf / "k-3.json").write_text("{broken")
    assert [r["id"] for r in S.read_manifests(spark, str(shelf)).collect()] == ["k-1"]
    pages = spark.createDataFrame([("k", 0, 1, "one", 3, 9), ("k", 1, 2, "two", None, None)], "doc_id string, seq long, page int, markdown string, ocr_chars int, ocr_total int")
    text = S.render_converted(pages, spark.createDataFrame([("k", "T")], "doc_id string, title string"))
    assert text.first()["text"] == "<!-- kb:source T -->\n\n<!-- kb:page 1 -->\n<!-- kb:ocr 3/9 -->\none\n\n<!-- kb:page 2 -->\ntwo\n"
    assert S.read_converted(text).orderBy("seq").collect() == pages.orderBy("seq").collect()


def test_streamed_sync(spark, tmp_path):
    inbox, table = tmp_path / "inbox", str(tmp_path / "table")
    inbox.mkdir()
    record = {"id": "k-1", "path": "p", "title": "A", "chars": 3}
    (inbox / "1.json").write_text(json.dumps(record))
    Y.follow_manifests(spark, str(inbox), table, str(tmp_path / "state"))
    (inbox / "2.json").write_text(json.dumps({**record, "title": "B"}) + "\n" + json.dumps({**record, "id": "k-2"}))
    Y.follow_manifests(spark, str(inbox), table, str(tmp_path / "state"))
    got = {r["id"]: r["title"] for r in Y.current_manifests(spark, table).collect()}
    assert got == {"k-1": "B", "k-2": "A"}


SOME = ["keyword_search", "hybrid_search", "paged_chunks", "distinct_titles", "titles_by_arrival", "resolved_links", "nearest_vectors", "parsed_notes", "eval_metrics"]


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()) if os.environ.get("ALL_QUERIES") else SOME)
def test_queries_equal_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for file in os.listdir(folder):
        con.execute(f"create view {file.split('.')[0]} as select * from '{folder}/{file}'")
    cur = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    want = [dict(zip(columns, row)) for row in cur.fetchall()]
    df = entry.queries()[name](spark, folder)
    assert sorted(df.columns) == sorted(columns)
    key = lambda row: repr([float(v) if isinstance(v, (int, float)) else v for _, v in sorted(row.items())])
    assert sorted(map(key, (r.asDict() for r in df.collect()))) == sorted(map(key, want))


def test_versions_of_known_contents(spark):
    docs = spark.createDataFrame([(1, "/x/one.md"), (2, "/x/one.md"), (3, "upload:one.md")], "doc_id long, source string")
    old = docs.withColumn("title", F.col("doc_id").cast("string")).withColumn("added_at", F.col("doc_id"))
    files = spark.createDataFrame([(2, "/x/one.md"), (9, "upload:one.md")], "file_id long, source string")
    told = lambda df: sorted(tuple(r) for r in df.select("file_id", "versions", "first_title", "last_id").collect())
    assert told(V.previous_versions(files, old)) == [(9, 3, "1", 3)]
    assert told(V.previous_versions(files, old, known=True)) == [(2, 3, "1", 3), (9, 3, "1", 3)]
