"""The tool loop against a plain loop over scripted replies, one conversation at a time."""

import json

from pyspark.sql import functions as F

from lodestone.plans import tools

PAGES = {"alpha": ["a1", "a2", "a3"], "beta": ["b1", "b2"], "both": ["a1", "b1", "c1"], "nothing": []}
SITES = {"alpha": ["http://x/1", "http://x/2"], "beta": ["http://x/2", "http://x/3"]}


def call(name, arguments):
    return {"function": {"name": name, "arguments": arguments}}


def local(query, **more):
    return call(tools.LOCAL, {"query": query, **more})


#: What the model says in each round, by question.
SCRIPTS = {
    "alpha": [[local("alpha")], [local("both"), local("alpha")], []],
    "silent": [[], []],
    "nothing": [[], [local("alpha")]],
    "beta": [[call("web_search", json.dumps({"query": "alpha"}))], [call("web_search", {"query": "beta"}), call("odd", {})], []],
    "many": [[local("alpha"), local("beta"), local("both")]] * 4,
    "excludes": [[local("alpha", exclude_ids=["a1", "zz"])], [call(tools.LOCAL, "{no")], []],
    "garbage": ["{not json", []],
    "both": [[local("")], []],
}
QUESTIONS = list(SCRIPTS)


def search(calls, known):
    rows = [(q, i, r) for q, ids in PAGES.items() for r, i in enumerate(ids, 1)]
    table = calls.sparkSession.createDataFrame(rows, "query string, id string, place int")
    left = calls.join(table, "query").join(known, ["qid", "id"], "left_anti")
    return left.select("qid", F.col("place").alias("rank"), "id", F.lit(0.5).alias("score"), F.lit("here").alias("location"), F.concat(F.lit("text "), "id").alias("content"))


def web(calls):
    rows = [(q, i, r) for q, urls in SITES.items() for r, i in enumerate(urls, 1)]
    table = calls.sparkSession.createDataFrame(rows, "query string, url string, place int")
    return calls.join(table, "query").select("qid", "place", F.lit("t").alias("title"), "url", F.lit("s").alias("snippet"))


def reply_of(question, round_):
    script = SCRIPTS[question]
    said = script[round_] if round_ < len(script) else []
    return said if isinstance(said, str) else json.dumps({"message": {"content": f"round {round_}", "tool_calls": said}})


def plain(question):
    """The loop for one conversation: (role, tool, what is listed or said) and how many calls were used."""
    messages, cited, sites, used, searched = [("user", None, question)], {}, {}, 0, False

    def run(name, query, exclude=()):
        if name == tools.LOCAL:
            new = [i for i in PAGES.get(query or question, []) if i not in cited and i not in exclude]
            for i in new:
                cited[i] = f"[S{len(cited) + 1}]"
            messages.append(("tool", name, [(cited[i], i) for i in new]))
            return new
        if name == "web_search":
            for u in SITES[query]:
                sites.setdefault(u, f"[W{len(sites) + 1}]")
            messages.append(("tool", name, [(sites[u], u) for u in SITES[query]]))
        else:
            messages.append(("tool", name, "error"))

    for r in range(tools.ROUNDS):
        said = SCRIPTS[question][r] if r < len(SCRIPTS[question]) else []
        asked = [] if isinstance(said, str) else said
        if not asked:
            if searched:
                break
            searched, used = True, used + 1
            if not run(tools.LOCAL, None):
                break
            continue
        messages.append(("assistant", None, f"round {r}"))
        for c in asked[: tools.CALLS - used]:
            a = c["function"]["arguments"]
            try:
                a = json.loads(a) if isinstance(a, str) else a
            except ValueError:
                a = {}
            run(c["function"]["name"], a.get("query"), a.get("exclude_ids", ()))
            used += 1
            searched |= c["function"]["name"] == tools.LOCAL
        if used >= tools.CALLS:
            break
    if not searched:
        run(tools.LOCAL, None)
    return [*messages, ("user", None, tools.FINAL)], used


def shown(content, tool):
    if tool is None:
        return content
    read = json.loads(content)
    return "error" if "error" in read else [(r["citation"], r.get("chunk_id") or r.get("url")) for r in read.get("results") or []]


def test_against_a_plain_loop(spark):
    asked = []

    def model(messages):
        asked.append(1)
        rows = [(q, r, reply_of(q, r)) for q in QUESTIONS for r in range(tools.ROUNDS)]
        script = messages.sparkSession.createDataFrame(rows, "question string, round int, reply string")
        first = messages.where("seq = 0").select("qid", F.col("content").alias("question"))
        return first.join(script.where(F.col("round") == len(asked) - 1), "question").select("qid", "reply")

    questions = spark.createDataFrame([(i, q, "clash") for i, q in enumerate(QUESTIONS)], "qid long, question string, name string")
    messages, used = tools.run(questions, model, search, web)
    got = {}
    for m in messages.orderBy("qid", "seq").collect():
        got.setdefault(QUESTIONS[m.qid], []).append((m.role, m.tool, shown(m.content, m.tool)))
    counts = {QUESTIONS[r.qid]: r.used for r in used.collect()}
    for q in QUESTIONS:
        wanted, n = plain(q)
        assert got[q] == wanted, q
        assert counts[q] == n <= tools.CALLS, q
    assert len(asked) <= tools.ROUNDS
