"""The engine: index pages, retrieve, ask, with jobs whose status can be read."""

from __future__ import annotations

import json
import uuid
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.config import EngineConfig
from textloom.functions.vectors import HashingEmbedder, embedded
from textloom.operators import dialogue, retrieval
from textloom.operators.chunking import FallbackTokenizer, Tokenizer, page_chunks
from textloom.operators.ingest import chosen_sources, to_crawl
from textloom.operators.store import ChunkStore, last_rows
from textloom.schemas import MESSAGE, PAGE
from textloom.session import cut


#: Folders over which sessions are spread.
BUCKETS = 256
#: Sources fetched again even if they are stored.
FORCED = ("release-notes",)


@dataclass
class Job:
    """State of a background job."""

    job_id: str
    sources: list[str]
    max_pages: int
    status: str = "running"
    current: str = ""
    index_size: int = 0
    stats: dict[str, dict[str, object]] = field(default_factory=dict)
    error: str | None = None


class Engine:
    """Chunks, their vectors and conversations of one store folder."""

    def __init__(self, spark: SparkSession, path: str, config: EngineConfig = EngineConfig(), tokenizer: Tokenizer | None = None, embedder: HashingEmbedder | None = None, generator: dialogue.Generator | None = None, admin_token: str | None = None) -> None:
        self.spark, self.config, self._admin = spark, config, admin_token
        self.tokenizer, self.embedder = tokenizer or FallbackTokenizer(), embedder or HashingEmbedder()
        # without a generator of the caller's own, questions with a history stay as they are
        self.rewriter, self.generator = generator, generator or dialogue.ExtractiveStub()
        self.store = ChunkStore(spark, f"{path}/chunks")
        self.pages = ChunkStore(spark, f"{path}/pages", PAGE, "url")
        self._messages_path, self._jobs_path = f"{path}/messages", f"{path}/jobs"
        self._new_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._new_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for folder in (self._messages_path, self._jobs_path):
            self._fs.mkdirs(self._new_path(folder))
        self._pool = ThreadPoolExecutor(1)
        self._futures: list[Future] = []

    def messages(self, session_id: str | None = None) -> DataFrame:
        """Messages of one session, or of all; a session lies in one of ``BUCKETS`` folders, the only one read for it."""
        rows = self.spark.read.schema(f"{MESSAGE}, bucket int").parquet(self._messages_path)
        if session_id is not None:
            rows = rows.filter((F.col("bucket") == F.pmod(F.xxhash64(F.lit(session_id)), F.lit(BUCKETS))) & (F.col("session_id") == session_id))
        return rows.drop("bucket")

    def chunks_of(self, pages: DataFrame) -> DataFrame:
        return page_chunks(pages, self.config, self.tokenizer).withColumn("embedding", embedded(F.col("text"), self.embedder))

    def index(self, pages: DataFrame, clear: bool = False, replace_pages: bool = False) -> DataFrame:
        """Chunk, embed and upsert pages; gives (pages, chunks, average). ``clear`` puts them in place of all there is, in one step."""
        chunks = self.chunks_of(pages)
        if clear:
            arrived = chunks.withColumn("_arrival", F.monotonically_increasing_id())
            self.store.commit(last_rows(arrived, "id", F.col("_arrival")))
        else:
            if replace_pages:
                self.store.replace_pages(pages.select("url"))
            self.store.upsert(chunks)
        own = self.store.read().join(pages.select(F.col("url").alias("u")).distinct(), F.col("metadata.url") == F.col("u"), "left_semi")
        counts = self.spark.createDataFrame([(pages.count(), own.count())], "pages long, chunks long")
        return counts.withColumn("average", F.try_divide("chunks", "pages"))

    def retrieve(self, queries: DataFrame, where: str | None = None) -> DataFrame:
        """Merged best contexts of (query_id, query); ``where`` filters on the chunks' metadata below the search."""
        asked = queries.withColumn("embedding", embedded(F.col("query"), self.embedder))
        index = self.store.read()
        index = index.filter(where) if where else index
        numbered = index.withColumn("vec_id", F.xxhash64("id"))
        hits = retrieval.nearest(asked, numbered, self.config.fan_in)
        rows = hits.join(numbered.select("vec_id", "id", "text", F.col("metadata.url").alias("url"), F.col("metadata.title").alias("title"), F.col("metadata.chunk_index").alias("chunk_index")), "vec_id")
        return retrieval.top_contexts(rows, self.config.top_k)

    def ask(self, message: str, session_id: str | None = None) -> dict:
        """Answer one message within its session: {answer, sources, session_id, rewritten_query}.

        A session idle for longer than the configured time begins anew; a blank message is an error.
        """
        message = (message or "").strip()
        if not message:
            raise ValueError("empty message")
        session = session_id or str(uuid.uuid4())
        told_before = self.messages(session)
        history = dialogue.last_messages(dialogue.live_messages(told_before, F.current_timestamp(), self.config.session_minutes), 2 * self.config.session_turns)
        question = self.spark.createDataFrame([(session, message)], "session_id string, message string")
        told = dialogue.rewritten_queries(question, history, self.rewriter, self.config).first()
        queries = self.spark.createDataFrame([(0, told.query)], "query_id long, query string")
        merged = self.retrieve(queries)
        context = retrieval.context_blocks(merged).select(F.lit(session).alias("session_id"), "context")
        prompt = dialogue.message_lists(question, history, context, self.config).select(F.element_at("messages", -1)["content"].alias("p")).first().p
        answer = self.generator.generate(pd.Series([prompt])).iloc[0]
        sources = [{"url": r.url, "title": r.title} for r in retrieval.cited_sources(merged).orderBy("position").collect()]
        # only the new turn is written; histories are cut to what is kept when they are read
        last = told_before.agg(F.max("pos")).first()[0]
        at = 0 if last is None else last + 1
        turn = self.spark.createDataFrame([(session, at, "user", message), (session, at + 1, "assistant", answer)], "session_id string, pos bigint, role string, content string")
        rows = turn.withColumns({"sent_at": F.current_timestamp(), "bucket": F.pmod(F.xxhash64("session_id"), F.lit(BUCKETS)).cast("int")})
        rows.coalesce(1).write.mode("append").partitionBy("bucket").parquet(self._messages_path)
        return {"answer": answer, "sources": sources, "session_id": session, "rewritten_query": told.rewritten}

    def health(self) -> dict:
        return {"status": "ok", "index_size": self.store.count()}

    def crawl(self, pages: DataFrame, source: str, max_pages: int | None = None, prefix: str | None = None, force: bool = False) -> dict:
        """Take pages of one source into the page table: new addresses only unless forced, the first ``max_pages`` by address."""
        part = chosen_sources(pages, [source], self.config.sources)
        part = part.filter(F.col("url").startswith(prefix)) if prefix else part
        listed = part.select("url").distinct()
        wanted = to_crawl(listed, self.pages.read(), "url", max_pages, F.col("url"), force=force or source in FORCED)
        wanted = cut(wanted)  # the page table changes before it is read again
        self.pages.upsert(part.join(wanted, "url", "left_semi").select(*self.pages.read().columns), F.col("scraped_at"), F.col("text"))
        done = wanted.count()
        return {"success": done, "failed": 0, "skipped": listed.count() - done, "error": None}

    def ingest(self, pages: DataFrame, sources: list[str], max_pages: int | None = 50, token: str | None = None) -> str:
        """Take in pages of the given sources in the background, then index all stored pages; 0 and None mean 50 pages a source."""
        if self._admin is not None and token != self._admin:
            raise PermissionError("wrong token")
        chosen_sources(pages, sources, self.config.sources)
        job = Job(uuid.uuid4().hex[:8], list(sources), max_pages or 50)
        self._note(job)
        self._futures.append(self._pool.submit(self._run, job, pages))
        return job.job_id

    def _run(self, job: Job, pages: DataFrame) -> None:
        try:
            for source in job.sources:
                if source not in self.config.sources:
                    continue
                job.current = source
                self._note(job)
                try:
                    job.stats[source] = self.crawl(pages, source, job.max_pages)
                except Exception as e:  # one source's failure leaves the others
                    job.stats[source] = {"success": 0, "failed": 0, "skipped": 0, "error": str(e)}
            job.current = "indexing"
            self._note(job)
            stored = self.pages.read()
            if not stored.isEmpty():
                self.index(stored, clear=True)
            job.index_size, job.status = self.store.count(), "done"
        except Exception as e:
            job.status, job.error = "failed", str(e)
        self._note(job)

    def _note(self, job: Job) -> None:
        """Write a job's state where other processes can read it."""
        stream = self._fs.create(self._new_path(f"{self._jobs_path}/{job.job_id}"), True)
        stream.writeUTF(json.dumps(asdict(job)))
        stream.close()

    def job(self, job_id: str) -> dict:
        """Status of a job, whichever process runs it; KeyError for an unknown one."""
        path = self._new_path(f"{self._jobs_path}/{job_id}")
        if not job_id.isalnum() or not self._fs.exists(path):
            raise KeyError(job_id)
        stream = self._fs.open(path)
        try:
            return json.loads(stream.readUTF())
        finally:
            stream.close()
