"""Question answering over the graph: analyse, retrieve, fuse, build context, reason, cite, remember."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import NAME_SEPARATORS, SEPARATORS
from ..operators import retrieval
from ..operators.dedup import last_turns

TURN = "session_id string, turn int, turn_id string, question string, answer string, domain string, evidence array<string>"
# Defaults of an analysis without a model.
DEFAULT_DOMAIN, DEFAULT_INTENT = "workforce", "query"
FALLBACK = "No answer could be made from the evidence."


@dataclass
class Query:
    domain: str = DEFAULT_DOMAIN
    intent: str = DEFAULT_INTENT
    entities: list[str] = field(default_factory=list)
    entity_types: dict[str, str] = field(default_factory=dict)
    sub_questions: list[str] = field(default_factory=list)


def analyze(question: str, model: Callable[[str], Query] | None = None) -> Query:
    """By the model, or by splitting on punctuation and keeping tokens of two characters or more."""
    if model:
        try:
            return model(question)
        except Exception:  # noqa: BLE001  any failure falls back
            pass
    words = [w for w in re.split(SEPARATORS, question) if len(w) >= 2]
    return Query(entities=words, entity_types=dict.fromkeys(words, "concept"), sub_questions=[question])


def names_in(question: str, most: int = 5) -> list[str]:
    return [w for w in re.split(NAME_SEPARATORS, question) if len(w) > 1][:most]


@dataclass
class Knowledge:
    """What retrievers read: graph, document nodes, table cards; any may be missing."""

    nodes: DataFrame
    edges: DataFrame
    documents: DataFrame | None = None
    tables: DataFrame | None = None


def retrieve(know: Knowledge, question: str, query: Query) -> DataFrame:
    """Documents and tables first; their distinct URIs then steer the graph search."""
    words = retrieval.expand_keywords(query.entities, names_in(question), query.sub_questions)
    found = []
    if know.documents is not None:
        found.append(retrieval.from_documents(know.documents, words))
    if know.tables is not None:
        found.append(retrieval.from_tables(know.tables, words, query.domain, query.intent))
    uris = None
    for f in found:
        part = f.select(F.col("content")["uri"].alias("uri")).where("uri IS NOT NULL")
        uris = part if uris is None else uris.unionByName(part)
    out = retrieval.from_graph(know.nodes, know.edges, uris, question, query.entities)
    for f in found:
        out = out.unionByName(f)
    return out


class Conversations:
    """An append-only table of turns."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def turns(self) -> DataFrame:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], TURN)
        return self.spark.read.schema(TURN).parquet(self.path)

    @staticmethod
    def new_session() -> str:
        return f"sess_{uuid.uuid4().hex[:12]}"

    def add(self, session: str, question: str, answer: str, domain: str, evidence: list[str]) -> str:
        n = self.turns().where(F.col("session_id") == session).count() + 1
        row = [(session, n, f"turn_{n}", question, answer, domain, evidence)]
        self.spark.createDataFrame(row, TURN).coalesce(1).write.mode("append").parquet(self.path)
        return f"turn_{n}"

    def history(self, session: str, n: int = 5) -> DataFrame:
        return last_turns(self.turns().where(F.col("session_id") == session), n, "session_id", "turn").orderBy("turn")


@dataclass
class Answer:
    session_id: str
    turn_id: str
    answer: str
    citations: list[str]
    evidence: list[str]


class Plugin:
    """One domain: subclass and set ``domain``; override ``reason`` for an answer by a model."""

    domain = DEFAULT_DOMAIN

    def reason(self, question: str, prompt: list[str]) -> str:
        return "\n".join(prompt[:5]) or FALLBACK

    def run(self, question: str, know: Knowledge, memory: Conversations, session: str | None = None, model=None) -> Answer:
        session = session or memory.new_session()
        query = analyze(question, model)
        fused = retrieval.fuse(retrieve(know, question, query), query.entities).cache()
        prompt = [r.line for r in retrieval.prompt_rows(fused).orderBy("evidence_id").collect()]  # bounded by the prompt's budget
        try:
            answer = self.reason(question, prompt)
        except Exception:  # noqa: BLE001  the fixed answer stands in
            answer = FALLBACK
        cites = [r.citation for r in retrieval.citations(fused).orderBy("citation").limit(100).collect()]
        used = [r.evidence_id for r in fused.select("evidence_id").orderBy("evidence_id").limit(200).collect()]
        fused.unpersist()
        return Answer(session, memory.add(session, question, answer, query.domain, used), answer, cites, used)


class Registry:
    """Plugins by domain; an unknown domain falls to the first one."""

    def __init__(self) -> None:
        self.plugins: dict[str, Plugin] = {}

    def register(self, plugin: Plugin) -> None:
        self.plugins[plugin.domain] = plugin

    def get(self, domain: str) -> Plugin:
        if not self.plugins:
            raise LookupError("no plugin is registered")
        return self.plugins.get(domain) or next(iter(self.plugins.values()))

    def ask(self, domain: str, question: str, know: Knowledge, memory: Conversations, session: str | None = None) -> Answer:
        return self.get(domain).run(question, know, memory, session)
