"""The tool loop for a table of conversations: replies, tool calls, searches, results, until no call is left.

Each round asks a given model function once for all open conversations, and then takes their first calls
together, their second ones, and so on, so the number of plans depends on the bounds (``ROUNDS``,
``CALLS``) and never on the number of conversations. A conversation leaves the loop when a reply has no call, when
its calls are used up, or when a forced search finds nothing. One that would answer without a local search
is made to search for its question.

Defined cases: a reply that can't be read has no call; arguments may be an object or JSON in a string; a
call without a query searches for the question; an unknown tool gets an error as its result; calls beyond the
bound are not run; records that a conversation has cited before are not offered again; a qid is one
conversation; no question gives no message. A model that gives no reply for a conversation has no call.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import retrieval
from lodestone.plans import ask, context
from lodestone.sources.staging import stage

ROUNDS, CALLS = 4, 8
LOCAL, WEB = "search_local_context", "web_search"
#: What a model is told before its last reply (fixed value).
FINAL = (
    "Write the final answer now using only the tool results above. Cite every factual claim with the source IDs in square brackets. "
    "If the sources are insufficient, say what information is missing."
)
MESSAGE = "seq long, role string, tool string, content string"
RESULT = "struct<citation:string,chunk_id:string,score:double,location:string,content:string>"


@dataclass
class Search:
    """A local search for many calls at once over an index.

    Called with ``calls(qid, query, budget)`` and ``known(qid, id)``, the ids that are not to come; gives rows
    (qid, rank, id, score, location, content).
    """

    records: DataFrame
    trust: DataFrame
    embed: Callable[[Column], Column]
    candidates: int = retrieval.CANDIDATES

    def __call__(self, calls: DataFrame, known: DataFrame) -> DataFrame:
        asked = calls.select("qid", F.col("query").alias("question"), self.embed(F.col("query")).alias("vector"))
        offered = ask.offers(self.records.select("id", "vector"), self.records, self.trust, asked, self.candidates)
        left = offered.join(known.select("qid", "id").distinct(), ["qid", "id"], "left_anti")
        left = left.select("qid", "ordinal", "place", "id").join(calls.select("qid", "budget"), "qid")
        ranked = ask.merged(retrieval.admitted(left, self.records, F.col("budget")), offered)
        rows = ask.tool_result(ranked, self.records)
        return rows.select("qid", "rank", F.col("chunk_id").alias("id"), "score", "location", "content")


def calls_of(replies: DataFrame) -> DataFrame:
    """Rows (qid, pos, name, query, exclude) of the tool calls of ``replies(qid, reply)``, in order."""
    each = replies.select("qid", F.posexplode(F.from_json(F.get_json_object("reply", "$.message.tool_calls"), "array<string>")).alias("pos", "call"))
    arguments = F.get_json_object("call", "$.function.arguments")
    named = each.select("qid", "pos", F.coalesce(F.get_json_object("call", "$.function.name"), F.lit("")).alias("name"), arguments.alias("a"))
    query = F.nullif(F.trim(F.get_json_object("a", "$.query")), F.lit(""))
    return named.select("qid", "pos", "name", query.alias("query"), F.coalesce(F.from_json(F.get_json_object("a", "$.exclude_ids"), "array<string>"), F.array().cast("array<string>")).alias("exclude"))


class _Loop:
    def __init__(self, questions: DataFrame, model, search, web, window: int, fraction: float, calls: int):
        self.spark, self.model, self.search, self.web, self.most = questions.sparkSession, model, search, web, calls
        self.budget = lambda used: context.context_budget(F.lit(window), F.lit(fraction), used)
        self.kind = questions.schema["qid"].dataType.simpleString()
        self.state = stage(questions.select("qid", F.coalesce("question", F.lit("")).alias("question"), F.lit(0).alias("used"), F.lit(False).alias("searched"), F.lit(True).alias("open")), "loop-state")
        self.messages = stage(questions.select("qid", F.lit(0).cast("long").alias("seq"), F.lit("user").alias("role"), F.lit(None).cast("string").alias("tool"), F.coalesce("question", F.lit("")).alias("content")), "loop-messages")
        self.cited = self.spark.createDataFrame([], f"qid {self.kind}, id string, number int")
        self.sites = self.cited
        self.seq = 0

    def say(self, rows: DataFrame) -> None:
        """Add messages (qid, role, tool, content), the next of their conversations."""
        self.seq += 1
        more = rows.select("qid", F.lit(self.seq).cast("long").alias("seq"), "role", "tool", "content")
        self.messages = stage(self.messages.unionByName(more), "loop-messages")

    def run_calls(self, calls: DataFrame) -> DataFrame:
        """Run one call (qid, name, query, exclude) of each conversation; rows (qid, n) of the results of local searches."""
        tokens = context.prompt_tokens(self.messages.select(F.col("qid").alias("conv_id"), "role", "content", F.col("tool").alias("tool_name"))).select(F.col("conv_id").alias("qid"), "tokens")
        calls = stage(calls.join(self.state.select("qid", "question"), "qid").join(tokens, "qid").select("qid", "name", F.coalesce("query", "question").alias("query"), "exclude", self.budget(F.col("tokens")).alias("budget")), "loop-calls")
        local = calls.where(F.col("name") == LOCAL)
        known = self.cited.select("qid", "id").unionByName(local.select("qid", F.explode("exclude").alias("id")))
        found = stage(self.search(local.select("qid", "query", "budget"), known), "loop-found")
        last = self.cited.groupBy("qid").agg(F.max("number").alias("last"))
        place = F.row_number().over(Window.partitionBy("qid").orderBy("rank")) + F.coalesce("last", F.lit(0))
        labelled = stage(found.join(last, "qid", "left").withColumn("number", place.cast("int")), "loop-labelled")
        self.cited = stage(self.cited.unionByName(labelled.select("qid", "id", "number")), "loop-cited")
        row = F.struct(F.concat(F.lit("[S"), "number", F.lit("]")).alias("citation"), F.col("id").alias("chunk_id"), F.round("score", 4).cast("double").alias("score"), "location", "content")
        rows = labelled.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("number", row.alias("r")))), lambda x: x["r"]).alias("results"))
        results = local.join(rows, "qid", "left").withColumn("results", F.coalesce("results", F.array().cast(f"array<{RESULT}>")))
        content = F.to_json(F.struct(F.lit(LOCAL).alias("tool"), "query", F.size("results").alias("result_count"), "results"))
        said = results.select("qid", F.lit("tool").alias("role"), F.lit(LOCAL).alias("tool"), content.alias("content"))
        rest = calls.where(F.col("name") != LOCAL)
        if self.web is not None:
            asked = rest.where(F.col("name") == WEB)
            each = stage(ask.web_result(self.web(asked.select("qid", "query")).join(asked.select("qid", "budget"), "qid"), F.col("budget")).drop("citation"), "loop-web")
            new = each.select("qid", F.col("url").alias("id"), "place").join(self.sites, ["qid", "id"], "left_anti").join(self.sites.groupBy("qid").agg(F.max("number").alias("last")), "qid", "left")
            number = F.row_number().over(Window.partitionBy("qid").orderBy("place")) + F.coalesce("last", F.lit(0))
            self.sites = stage(self.sites.unionByName(new.select("qid", "id", number.cast("int").alias("number"))), "loop-sites")
            each = each.join(self.sites.withColumnRenamed("id", "url"), ["qid", "url"]).withColumn("citation", F.concat(F.lit("[W"), "number", F.lit("]")))
            listed = each.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", F.struct("citation", "url", "title", "snippet").alias("r")))), lambda x: x["r"]).alias("results"))
            web = asked.join(listed, "qid", "left")
            content = F.to_json(F.struct(F.lit(WEB).alias("tool"), "query", F.coalesce(F.size("results"), F.lit(0)).alias("result_count"), "results"))
            said = said.unionByName(web.select("qid", F.lit("tool").alias("role"), F.lit(WEB).alias("tool"), content.alias("content")))
            rest = rest.where(F.col("name") != WEB)
        error = F.to_json(F.struct(F.concat(F.lit("Unknown tool: "), F.coalesce(F.nullif("name", F.lit("")), F.lit("unknown"))).alias("error")))
        self.say(said.unionByName(rest.select("qid", F.lit("tool").alias("role"), "name", error.alias("content")).withColumnRenamed("name", "tool")))
        return results.select("qid", F.size("results").alias("n"))

    def forced(self, of: DataFrame) -> DataFrame:
        none = F.lit(None).cast("string")
        return self.run_calls(of.select("qid", F.lit(LOCAL).alias("name"), none.alias("query"), F.array().cast("array<string>").alias("exclude")))

    def round(self) -> None:
        open_ = self.state.where("open")
        replies = stage(self.model(self.messages.join(open_.select("qid"), "qid", "left_semi")).select("qid", "reply"), "loop-replies")
        calls = calls_of(replies).join(open_.select("qid", "used"), "qid")
        calls = stage(calls.where(F.col("pos") < F.lit(self.most) - F.col("used")).select("qid", "pos", "name", "query", "exclude"), "loop-planned")
        counts = calls.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("name") == LOCAL).alias("local"))
        marked = stage(self.state.join(counts, "qid", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "local": F.coalesce("local", F.lit(False))}), "loop-state")
        talking = marked.where("open AND n > 0")
        self.say(talking.join(replies, "qid").select("qid", F.lit("assistant").alias("role"), F.lit(None).cast("string").alias("tool"), context.message_parts(F.col("reply"))["content"].alias("content")))
        most = calls.agg(F.coalesce(F.max("pos"), F.lit(-1)).alias("m")).first()["m"]
        for pos in range(most + 1):  # CALLS at most
            self.run_calls(calls.where(F.col("pos") == pos))
        silent = marked.where("open AND n = 0 AND NOT searched")
        got = self.forced(silent).select("qid", F.col("n").alias("forced"))
        after = marked.join(got, "qid", "left")
        used = F.col("used") + F.col("n") + F.col("forced").isNotNull().cast("int")
        goes_on = F.col("open") & F.when(F.col("n") > 0, used < self.most).otherwise(F.coalesce(F.col("forced") > 0, F.lit(False)))
        searched = F.col("searched") | F.col("local") | F.col("forced").isNotNull()
        self.state = stage(after.select("qid", "question", used.cast("int").alias("used"), searched.alias("searched"), goes_on.alias("open")), "loop-state")


def run(
    questions: DataFrame, model: Callable[[DataFrame], DataFrame], search: Callable[[DataFrame, DataFrame], DataFrame], web: Callable[[DataFrame], DataFrame] | None = None,
    window: int = 8192, fraction: float = context.MOST_FRACTION, rounds: int = ROUNDS, calls: int = CALLS,
) -> tuple[DataFrame, DataFrame]:
    """Messages (qid, seq, role, tool, content) that the last reply is to be made from, and (qid, used) calls.

    ``questions(qid, question)``; ``model`` makes (qid, reply in JSON) from messages; ``search`` is a ``Search`` or
    alike; ``web`` makes (qid, place, title, url, snippet) from calls (qid, query).
    """
    loop = _Loop(questions, model, search, web, window, fraction, calls)
    for _ in range(rounds):
        if loop.state.where("open").isEmpty():
            break
        loop.round()
    missing = loop.state.where("NOT searched")
    if not missing.isEmpty():
        loop.forced(missing)
    loop.say(loop.state.select("qid", F.lit("user").alias("role"), F.lit(None).cast("string").alias("tool"), F.lit(FINAL).alias("content")))
    return loop.messages, loop.state.select("qid", "used")
