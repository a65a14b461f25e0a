"""The whole in one place: a knowledge base's tables, and searches over one or two of them.

Every method takes a frame of questions and returns one frame of hits, so a thousand questions are
one pass over the chunks. What is used twice on the way (matches, candidates, a first list) is written
to the shared folder while the frame is being built. Embedding and language models are callables the user passes in.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmark.functions.vectors import profile_for
from shelfmark.operators import catalog, fusion, keyword, planning, semantic, similarity
from shelfmark.operators.index import SearchIndex
from shelfmark.session import checkpoint

HIT = ["query_id", "rank", "chunk_id", "doc_id", "page", "title", "heading", "snippet", "score", "match"]


@dataclass(frozen=True)
class KnowledgeBase:
    """Tables as the operators describe them; ``stats`` is ``keyword.corpus_stats`` kept from the build,
    ``index`` the search index of the chunks: with it no search reads texts to find chunks; or ``scan`` (``keyword.candidates``)."""

    docs: DataFrame
    chunks: DataFrame
    shelves: DataFrame
    vectors: DataFrame | None = None
    model: str | None = None
    embedder: semantic.Embedder | None = None
    min_score: float | None = None
    stats: DataFrame | None = None
    index: SearchIndex | str | None = None

    def visible(self, collection: str | None = None, any_of: list[str] | None = None, only: str | None = None) -> DataFrame | None:
        """Documents in reach (doc_id), or None for all of them."""
        if collection is None and any_of is None and only is None:
            return None
        seen = catalog.visible(self.docs, self.shelves, any_of, only)
        return (seen.filter(F.col("collection") == collection) if collection else seen).select("doc_id")

    def search(self, queries: DataFrame, limit: int = 8, **scope) -> DataFrame:
        hits = keyword.search(self.chunks, queries, self.visible(**scope), limit, self.stats, self.index or "auto")
        return hits.withColumn("match", F.lit("keyword")).select(HIT)

    def semantic_ready(self) -> bool:
        ready = self.embedder is not None and self.model is not None and self.vectors is not None
        return ready and not self.vectors.filter(F.col("model") == self.model).isEmpty()

    def near(self, queries: DataFrame, **scope) -> DataFrame:
        """Chunks close in meaning, above the floor: query_id, chunk_id, score, rank."""
        asked = semantic.embed_queries(queries, self.embedder, profile_for(self.model))
        vectors = semantic.purge_other_models(self.vectors, self.model)
        seen = self.visible(**scope)
        if seen is not None:
            vectors = vectors.join(seen, "doc_id", "left_semi")
        return semantic.above_floor(semantic.nearest(asked, vectors), self.model, self.min_score)

    def find_semantic(self, queries: DataFrame, limit: int = 8, **scope) -> DataFrame:
        top = self.near(queries, **scope).filter(F.col("rank") <= limit)
        return keyword.hydrate(top, self.chunks).withColumn("match", F.lit("semantic")).select(HIT)

    def find(self, queries: DataFrame, limit: int = 8, **scope) -> DataFrame:
        """Keyword and semantic hits fused by rank; keywords alone while there are no vectors to ask."""
        if not self.semantic_ready():
            return self.search(queries, limit, **scope)
        words = checkpoint(self.search(queries, fusion.LIST_LENGTH, **scope))
        fused = fusion.hybrid(words, self.near(queries, **scope), limit)
        whole = keyword.hydrate(fused, self.chunks)
        found = words.select("query_id", "chunk_id", F.col("snippet").alias("_snippet"))
        return (
            whole.join(found, ["query_id", "chunk_id"], "left")
            .withColumn("snippet", F.coalesce("_snippet", "snippet"))
            .select(HIT)
        )

    def mutual_notes(self, limit: int = 3) -> DataFrame:
        """Pairs of notes (a < b) that a search for each other's title finds first, where meaning had a say.

        All titles are one batch over the notes' chunks; a note itself and notes titled alike are left out of its hits.
        """
        notes = self.docs.filter("collection = 'wiki'").select("doc_id", "title")
        if not self.semantic_ready():
            return notes.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b")).limit(0)
        asked = notes.filter(F.trim("title") != "").select(F.col("doc_id").alias("query_id"), F.col("title").alias("query"))
        hits = checkpoint(self.find(asked, limit + 1, collection="wiki"))
        floor = self.min_score if self.min_score is not None else profile_for(self.model).min_score
        titled = asked.select("query_id", F.col("query").alias("title"), F.col("query_id").alias("exclude"))
        similar = similarity.similar_notes(titled, notes, hits, floor is not None, limit)
        first = similar.filter("why = 'search'").groupBy("query_id").agg(F.min_by(F.struct("doc_id", "match"), "pos").alias("x"))
        # By words alone related notes are found too, which repeat nothing.
        best = first.filter("x.match <> 'keyword'").select(F.col("query_id").alias("id"), F.col("x.doc_id").alias("best"))
        return similarity.mutual_best(checkpoint(best))


@dataclass(frozen=True)
class Library:
    """The global knowledge base, and a project's own with the shelves it uses of the global one."""

    everywhere: KnowledgeBase
    project: KnowledgeBase | None = None
    shelves: list[str] | None = None

    def _merge(self, method: str, queries: DataFrame, limit: int, collection: str | None, shelf: str | None) -> DataFrame:
        seen = {"only": shelf} if shelf is not None else {"any_of": self.shelves}
        wide = getattr(self.everywhere, method)(queries, limit, collection=collection, **seen)
        if self.project is None or shelf is not None:
            return wide.withColumn("scope", F.lit("global"))
        return fusion.merge_scopes(getattr(self.project, method)(queries, limit, collection=collection), wide, limit)

    def search(self, queries: DataFrame, limit: int = 8, collection: str | None = None, shelf: str | None = None) -> DataFrame:
        return self._merge("search", queries, limit, collection, shelf)

    def find(self, queries: DataFrame, limit: int = 8, collection: str | None = None, shelf: str | None = None) -> DataFrame:
        return self._merge("find", queries, limit, collection, shelf)

    def find_semantic(self, queries: DataFrame, limit: int = 8, collection: str | None = None, shelf: str | None = None) -> DataFrame:
        return self._merge("find_semantic", queries, limit, collection, shelf)

    def _bases(self) -> list[KnowledgeBase]:
        return [b for b in (self.project, self.everywhere) if b is not None]

    def semantic_ready(self) -> bool:
        return any(b.semantic_ready() for b in self._bases())

    def unmentioned(self, questions: DataFrame) -> DataFrame:
        """Part numbers in questions that neither knowledge base mentions."""
        return reduce(
            lambda left, right: left.join(right, ["query_id", "part", "ord"], "left_semi"),
            [keyword.unmentioned_parts(questions, b.chunks, b.index or "auto") for b in self._bases()],
        )

    def retrieve(self, searches: DataFrame, limit: int) -> DataFrame:
        """Several searches per question merged: question_id, pos, scope, chunk_id, score.

        ``searches``: question_id, searches (array). By meaning only for questions no keyword search
        found anything for.
        """
        asked = checkpoint(
            searches.select("question_id", F.posexplode("searches").alias("search", "query")).withColumn(
                "query_id", F.concat_ws("#", F.col("question_id").cast("string"), F.col("search").cast("string"))
            )
        )

        def merged(method: str, of: DataFrame) -> DataFrame:
            hits = self._merge(method, of.select("query_id", "query"), planning.PER_SEARCH, None, None)
            named = hits.join(of.select("query_id", "question_id", "search"), "query_id")
            return fusion.merge_searches(named.select("question_id", "search", "scope", "chunk_id", "rank"), limit)

        if not self.semantic_ready():
            return merged("search", asked)
        found = checkpoint(merged("search", asked))
        open_ = checkpoint(asked.join(found.select("question_id").distinct(), "question_id", "left_anti"))
        return found if open_.isEmpty() else found.unionByName(merged("find", open_))

    def passages(self, found: DataFrame, unreviewed: DataFrame) -> DataFrame:
        """The texts of retrieved chunks, numbered per question."""
        parts = [
            planning.passages(found.filter(F.col("scope") == scope), base.chunks, unreviewed)
            for scope, base in (("project", self.project), ("global", self.everywhere))
            if base is not None
        ]
        return reduce(DataFrame.unionByName, parts)

    def overview(self) -> str:
        """What a planner is told: titles within a few thousand characters, of what the project can see."""
        seen = catalog.visible(self.everywhere.docs, self.everywhere.shelves, self.shelves)
        titles = reduce(DataFrame.unionByName, [d.select("title") for d in ([self.project.docs] if self.project else []) + [seen]])
        lines = planning.contents(titles).orderBy("pos").collect()
        return "Titles: " + "; ".join(r["line"] for r in lines)

    def ask(self, spark: SparkSession, question: str, model: planning.Model, plan_prompt: str, answer_prompt: str, unreviewed: DataFrame) -> dict:
        """One question answered from at most eight passages, with citations numbered by first use."""
        reply = planning.plan_searches(model, plan_prompt, question, self.overview())
        one = spark.createDataFrame([(0, question, reply)], "question_id long, question string, reply string")
        searches = one.select("question_id", planning.parse_searches("reply", planning.clean_question("question")).alias("searches"))
        found = checkpoint(self.retrieve(searches, planning.MAX_PASSAGES))
        rows = self.passages(found, unreviewed).orderBy("n").collect()
        missing = self.unmentioned(one.select(F.col("question_id").alias("query_id"), F.col("question").alias("query")))
        said = planning.answer_question(model, answer_prompt, question, rows, [r["part"] for r in missing.orderBy("ord").collect()] if rows else [])
        answer = spark.createDataFrame([(said,)], "answer string").select(
            planning.renumber("answer", len(rows)).alias("text"), planning.cited_numbers("answer", len(rows)).alias("used")
        ).first()
        return {"answer": answer["text"], "sources": [rows[n - 1].asDict() | {"n": i + 1} for i, n in enumerate(answer["used"])]}
