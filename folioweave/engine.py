"""A corpus and its graph behind one object: build, query, pack, stats, node, neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text as T
from .operators import graph, lexical, retrieve, vector
from .sources.tables import written


class DocumentGraph:
    """Over a corpus of (file_path, text).  ``embed`` turns a column of text into vectors of length 1."""

    def __init__(self, corpus: DataFrame, catalog: dict[str, list[str]] | None = None, embed=None):
        self.embed = embed or (lambda text: vector.hashed_embedding(T.tokens(text)))
        held = graph.store(*graph.build(corpus, catalog))
        self.nodes, self.edges, self.ways = held["nodes"], held["edges"], held["ways"]
        self.chunks = self.nodes.where("kind = 'chunk'")
        words = lexical.store(self.chunks)
        self.postings, self.sizes = words["postings"], tuple(words["sizes"].first())
        index = T.index_text(F.col("kind"), F.col("id"), F.lit(None).cast("string"), F.col("file_path"), F.col("text"))
        self.vectors = written(self.chunks.select("id", "kind", "file_path", self.embed(index).alias("vector")), "vectors")

    def write(self, folder: str) -> None:
        """Nodes by kind, edges by relation, postings and vectors, as Parquet."""
        self.nodes.write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/nodes")
        self.edges.write.mode("overwrite").partitionBy("rel").parquet(f"{folder}/edges")
        self.ways.write.mode("overwrite").parquet(f"{folder}/ways")
        self.postings.write.mode("overwrite").parquet(f"{folder}/postings")
        self.vectors.write.mode("overwrite").parquet(f"{folder}/vectors")

    @classmethod
    def read(cls, spark, folder: str, embed=None) -> DocumentGraph:
        self = cls.__new__(cls)
        self.embed = embed or (lambda text: vector.hashed_embedding(T.tokens(text)))
        self.nodes, self.edges, self.ways, self.postings, self.vectors = (spark.read.parquet(f"{folder}/{x}") for x in ("nodes", "edges", "ways", "postings", "vectors"))
        self.chunks = self.nodes.where("kind = 'chunk'")
        self.sizes = lexical.corpus_size(self.chunks)
        return self

    def seeds(self, question: str, k: int = 8, prefixes: list[str] | None = None, kinds: list[str] | None = None) -> DataFrame:
        """(id, score, dist, self_dist, rank) by words and vectors together, in scope and without front matter."""
        if not question.strip():
            raise ValueError("the question is empty")
        if isinstance(k, bool) or not 1 <= k <= 100:
            raise ValueError("k goes from 1 to 100")
        spark = self.nodes.sparkSession
        scope = retrieve.in_scope(prefixes, kinds) if prefixes or kinds else None
        asked = spark.createDataFrame([(question,)], "q string").select(self.embed(F.col("q")).alias("v")).first().v
        dense = vector.nearest(self.vectors, list(asked), min(100, 3 * k), scope)
        words = lexical.bm25(self.postings, question, *self.sizes, limit=3 * k, scope=None if scope is None else self.nodes.where(scope))
        return retrieve.fuse(retrieve.seed_candidates(dense, self.nodes), retrieve.seed_candidates(words, self.nodes), k)

    def query(self, question: str, k: int = 8, hops: int = 1, most: int = 25, prefixes: list[str] | None = None, kinds: list[str] | None = None) -> DataFrame:
        return retrieve.query(self.nodes, self.edges, self.seeds(question, k, prefixes, kinds), hops, most, prefixes, kinds, self.ways)

    def pack(self, question: str, k: int = 8, hops: int = 1, most: int = 15, chars: int = 2000, prefixes: list[str] | None = None, kinds: list[str] | None = None, traced: bool = False) -> DataFrame:
        return retrieve.pack(self.nodes, self.edges, self.seeds(question, k, prefixes, kinds), hops, most, chars, prefixes, kinds, traced, self.ways)

    def similar(self, k: int = 5, threshold: float = 0.85, max_degree: int = 0) -> DataFrame:
        """SIMILAR_TO edges between chunks."""
        return vector.similar_edges(self.vectors.select("id", "vector"), k, threshold, max_degree)

    def nodes_of(self, ids: DataFrame) -> DataFrame:
        """The nodes of a table of ids (id)."""
        return self.nodes.join(ids.select("id").distinct(), "id", "left_semi")

    def count(self, kind: str | None = None) -> int:
        return (self.nodes.where(F.col("kind") == kind) if kind else self.nodes).count()

    def stats(self) -> DataFrame:
        return graph.stats(self.nodes, self.edges)

    def node(self, node_id: str) -> DataFrame:
        return self.nodes.where(F.col("id") == node_id)

    def neighbours(self, node_id: str, **how) -> DataFrame:
        return graph.neighbours(self.nodes, self.edges, node_id, **how)
