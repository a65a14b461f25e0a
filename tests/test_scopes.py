"""Two knowledge bases: listing, status, moves between them and what an import plan puts where."""

from shelfmark.operators import catalog as C, versions as V

DOC = "doc_id string, title string, collection string, pages int"


def test_everything_is_listed_with_global_shelves_only(spark):
    own = spark.createDataFrame([("n1", "N", "wiki", None)], DOC)
    docs = spark.createDataFrame([("n1", "N", "wiki", None), ("d1", "D", "docs", 3), ("d2", "E", "docs", 1)], DOC)
    shelves = spark.createDataFrame([("n1", "B"), ("n1", "A"), ("n1", "A"), ("d1", "A"), ("gone", "A")], "doc_id string, shelf string")
    got = {(r["scope"], r["doc_id"]): r["shelves"] for r in C.list_everything(own, docs, shelves).collect()}
    assert got == {("project", "n1"): None, ("global", "n1"): ["A", "B"], ("global", "d1"): ["A"], ("global", "d2"): None}
    assert [r["doc_id"] for r in C.list_everything(None, docs, shelves, "docs").orderBy("doc_id").collect()] == ["d1", "d2"]
    assert C.list_everything(own.limit(0), docs.limit(0), shelves).count() == 0


def test_status_of_each_scope(spark):
    docs = spark.createDataFrame([("d1", "D", "docs", 3), ("n1", "N", "wiki", None)], DOC)
    tables = {
        "docs": docs,
        "chunks": spark.createDataFrame([(1, "d1"), (2, "d1"), (3, "n1")], "chunk_id long, doc_id string"),
        "shelves": spark.createDataFrame([("d1", "A"), ("n1", "A"), ("n1", "B")], "doc_id string, shelf string"),
        "ocr_pending": spark.createDataFrame([("n1",)], "doc_id string"),
        "vectors": spark.createDataFrame([(1, "m"), (2, "old")], "chunk_id long, model string"),
    }
    empty = {name: t.limit(0) for name, t in tables.items()}
    got = {r["scope"]: r.asDict() for r in C.library_status({"project": empty, "global": tables}, "m").collect()}
    assert got["global"]["shelves"] == 2 and got["project"]["shelves"] == 0
    assert [got["global"][k] for k in ("docs", "wiki", "pages", "chunks", "reading", "done", "ready")] == [1, 1, 3, 3, 1, 1, 2]
    assert [got["project"][k] for k in ("chunks", "reading", "done", "ready")] == [0, 0, 0, 0]


def test_a_document_leaves_its_shelves_in_the_project(spark):
    rows = spark.createDataFrame([("a", "A", "global"), ("b", "B", "global"), ("p", "b", "project"), ("q", "Q", "project")], "doc_id string, title string, scope string")
    shelves = spark.createDataFrame([(i, "S") for i in "abpq"], "doc_id string, shelf string")
    left = lambda to: sorted(r["doc_id"] for r in V.shelves_after_move(shelves, V.move_scope(rows, rows, to)).collect())
    assert left("project") == ["b", "p", "q"]  # b is refused, p and q are there already
    assert left("global") == ["a", "b", "p", "q"]


def test_where_an_import_goes(spark):
    rows = [(1, "global", "Bus", 0), (2, "global", "bus", 2), (3, "global", None, 0), (4, "project", "Bus", 1), (5, "project", None, 0)]
    plan = spark.createDataFrame(rows, "file_id long, scope string, shelf string, versions long")
    got = sorted(map(tuple, V.placement_counts(plan).collect()), key=str)
    assert got == sorted([("global", "Bus", 2, 1), ("global", None, 1, 0), ("project", None, 2, 1)], key=str)
    assert V.placement_counts(plan.limit(0)).count() == 0
