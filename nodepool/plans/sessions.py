"""Queries over conversations as sessions: windows, recall, tools, prompts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import session as C
from ..sources.shared import shared_dir
from ..streaming import streams
from . import sql as S
from .documents import TAGGER, table

WINDOW = 2
TOOLS = [
    {"name": "ledger", "description": "Amount of total spending over a range of dates, from invoices.", "call": {"since": "date", "until": "date"}, "returns": {"amount": "number"}},
    {"name": "agenda", "description": "Meetings that are scheduled on a calendar.", "call": {"about": "string"}, "returns": {"meetings": "list"}},
    {"name": "grep", "description": "Search of source code for a symbol.", "call": {"symbol": "string"}, "returns": {"places": "list"}},
    {"name": "sky", "description": "Weather forecast of a city.", "call": {"city": "string"}, "returns": {"weather": "string"}},
]
#: Words of the tables' prose in place of those that people use when they want a tool.
ASKS = [("thing", C.INTENTS[0][1]), ("nicht|enlich", C.INTENTS[1][1]), ("mente|para", C.INTENTS[2][1]), ("eau|queque", C.INTENTS[3][1])]


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


def q_window(spark, sf_dir):
    return C.windows(_turns(spark, sf_dir), WINDOW).select("conv_id", "turn", "in_window")


def q_recall(spark, sf_dir):
    """For each turn, the three best of those that had left the window of two turns."""
    found = C.recall(_turns(spark, sf_dir), WINDOW, TAGGER)
    return found.select("conv_id", "turn", "rank", "hit_turn", F.round("score", 6).alias("score"), F.round("raw", 6).alias("raw"))


def q_conversation(spark, sf_dir):
    return C.conversation(_turns(spark, sf_dir), 3)


def q_intent(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", C.intent(F.col("text"), ASKS).alias("intent"))


def q_tools(spark, sf_dir):
    """The tools that answer the wish of each turn that has one."""
    found = C.tool_hits(_turns(spark, sf_dir), C.tools_frame(spark, TOOLS), TAGGER, cascade=ASKS)
    return found.select("conv_id", "turn", "intent", "rank", "id", F.round("score", 6).alias("score"))


def q_prompt(spark, sf_dir):
    """The prompt of each conversation's last user turn, with its window and what it recalls."""
    turns = _turns(spark, sf_dir)
    last = turns.filter("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("user"), F.max("turn").alias("turn"))
    hits = C.recall(turns, WINDOW, TAGGER).join(last.select("conv_id", "turn"), ["conv_id", "turn"], "left_semi")
    texts = turns.select("conv_id", F.col("turn").alias("hit_turn"), "text")
    lines = F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("- "), F.col("text")).alias("line"))))
    recalled = hits.join(texts, ["conv_id", "hit_turn"]).groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("recalled"))
    tools = C.tools_frame(spark, TOOLS)
    wanted = C.tool_lines(C.tool_hits(last.withColumnRenamed("user", "text"), tools, TAGGER, cascade=ASKS), tools).drop("turn")
    rows = last.join(C.conversation(turns, WINDOW), "conv_id", "left").join(recalled, "conv_id", "left").join(wanted, "conv_id", "left")
    return rows.select("conv_id", C.prompt(F.lit(C.SYSTEM), F.col("tools"), F.col("lines"), F.col("recalled"), F.when(F.col("turn") >= 4, F.lit("Be brief.")), F.col("user")).alias("prompt"))


def q_session(spark, sf_dir):
    """Sizes of the window and of the long-term pool of each conversation after each turn,
    and the turn that went from one to the other."""
    return C.replay(_turns(spark, sf_dir), WINDOW)


def q_reply(spark, sf_dir):
    """What the stand-in for a model answers each turn, with a tool, a memory, a nudge or none."""
    tool = F.when(F.col("turn") % 2 == 0, F.lit("grep"))
    memory, nudge = F.when(F.col("turn") % 3 == 0, F.col("role")), F.when(F.col("turn") == 4, F.lit("be brief"))
    return _turns(spark, sf_dir).select("conv_id", "turn", C.reply(F.col("text"), tool, F.when(tool.isNotNull(), F.lit("symbol")), memory, nudge, F.when(F.col("turn") == 5, F.lit("scripted"))).alias("reply"))


def _streamed(spark, sf_dir, start) -> str:
    """Runs a stream over the table of conversations to its end; start gets it with two new folders."""
    source = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    # a stream reads folders: the table may be one file
    source.write.parquet(f"{folder}/in")
    start(spark.readStream.schema(source.schema).parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/mark").awaitTermination()
    return f"{folder}/out"


def q_stream_index(spark, sf_dir):
    """An index that follows a stream of turns: a pool a role."""
    path = _streamed(spark, sf_dir, lambda rows, out, mark: streams.index_stream(rows.select(F.col("role").alias("pool"), F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("content_text")), out, mark, TAGGER))
    return streams.read_index(spark, path).docs.select("pool", "id", "doc_len", F.array_join("terms", " ").alias("terms"))


def q_stream_spill(spark, sf_dir):
    """The turns that leave their conversation's window, by a stateful stream."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    put = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path[0]}/batch={number}")
    path: list[str] = []

    def start(rows, out, mark):
        path.append(out)
        return streams.each_batch(streams.spilled(rows.select("conv_id", "turn", "text"), WINDOW), put, mark)

    _streamed(spark, sf_dir, start)
    return spark.read.parquet(path[0]).select("conv_id", "turn", "text")


QUERIES = {f.__name__: f for f in (q_window, q_recall, q_conversation, q_intent, q_tools, q_prompt, q_session, q_reply, q_stream_index, q_stream_spill)}

_RECALL = f"""{S.terms('conversations', 'conv_id, turn', 'text', 'ct')},
lens AS (SELECT conv_id, turn, CAST(count(*) AS DOUBLE) AS doc_len FROM ct GROUP BY conv_id, turn),
stats AS (SELECT q.conv_id, q.turn, CAST(count(*) AS DOUBLE) AS n, sum(l.doc_len) / count(*) AS mean FROM conversations q JOIN lens l ON l.conv_id = q.conv_id AND l.turn <= q.turn - {WINDOW} GROUP BY q.conv_id, q.turn),
dfs AS (SELECT q.conv_id, q.turn, q.term, q.pos, CAST(count(*) AS DOUBLE) AS df FROM ct q JOIN ct d ON d.conv_id = q.conv_id AND d.term = q.term AND d.turn <= q.turn - {WINDOW} GROUP BY q.conv_id, q.turn, q.term, q.pos),
wt AS (SELECT d.*, ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) AS idf, s.mean FROM dfs d JOIN stats s ON s.conv_id = d.conv_id AND s.turn = d.turn),
reach AS (SELECT conv_id, turn, sum(idf ORDER BY pos) AS achievable FROM wt GROUP BY conv_id, turn),
raws AS (SELECT w.conv_id, w.turn, d.turn AS hit_turn, sum(w.idf * (2.2 / (1 + 1.2 * (0.6 + 0.4 * l.doc_len / w.mean))) ORDER BY w.pos) AS raw
         FROM wt w JOIN ct d ON d.conv_id = w.conv_id AND d.term = w.term AND d.turn <= w.turn - {WINDOW} JOIN lens l ON l.conv_id = d.conv_id AND l.turn = d.turn GROUP BY w.conv_id, w.turn, d.turn),
sc AS (SELECT r.*, 1.0 / (1.0 + exp(-6.0 * (raw / achievable - 0.5))) AS score FROM raws r JOIN reach a ON a.conv_id = r.conv_id AND a.turn = r.turn),
rec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, CAST(hit_turn AS VARCHAR)) AS rank FROM sc) x WHERE rank <= 3)"""


def _lines(size: int) -> str:
    return f"(SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS lines FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) w WHERE back <= {size} AND text IS NOT NULL GROUP BY conv_id)"


#: The tools' values as text, written out by hand, and their lines in a prompt.
_TOOL_TEXTS = {
    "ledger": "ledger Amount of total spending over a range of dates, from invoices. date date number",
    "agenda": "agenda Meetings that are scheduled on a calendar. string list",
    "grep": "grep Search of source code for a symbol. string list",
    "sky": "sky Weather forecast of a city. string string",
}
_TOOL_LINES = {
    "ledger": '- ledger({"since":"date","until":"date"}) -> {"amount":"number"}|  Amount of total spending over a range of dates, from invoices.',
    "agenda": '- agenda({"about":"string"}) -> {"meetings":"list"}|  Meetings that are scheduled on a calendar.',
    "grep": '- grep({"symbol":"string"}) -> {"places":"list"}|  Search of source code for a symbol.',
    "sky": '- sky({"city":"string"}) -> {"weather":"string"}|  Weather forecast of a city.',
}
_INTENT = "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{w}'" for p, w in ASKS) + " END"


def _tools_cte() -> str:
    nodes = ", ".join(f"('tools', 'tool-{name}', '{text}')" for name, text in _TOOL_TEXTS.items())
    queries = ", ".join(f"('{wish}', 'tools', '{wish}')" for _, wish in ASKS)
    return f"""nodes AS (SELECT * FROM (VALUES {nodes}) v(pool, id, text)), queries AS (SELECT * FROM (VALUES {queries}) v(query_id, pool, text)), {S.scored('nodes', 'queries')}, {S.ranked('TRUE', 2)}"""


def _tool_lines_cte() -> str:
    return "lines AS (SELECT * FROM (VALUES " + ", ".join(f"('tool-{name}', replace('{line}', '|', chr(10)))" for name, line in _TOOL_LINES.items()) + ") v(id, line))"


ORACLE_SQL = {
    "q_window": f"SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= {WINDOW} AS in_window FROM conversations",
    "q_recall": f"WITH {_RECALL} SELECT conv_id, turn, rank, hit_turn, round(score, 6) AS score, round(raw, 6) AS raw FROM rec",
    "q_conversation": f"SELECT * FROM {_lines(3)} x",
    "q_intent": "SELECT conv_id, turn, CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{w}'" for p, w in ASKS) + " END AS intent FROM conversations",
    "q_tools": f"WITH {_tools_cte()}, w AS (SELECT conv_id, turn, {_INTENT} AS intent FROM conversations) SELECT conv_id, turn, intent, rank, id, round(score, 6) AS score FROM w JOIN ranked r ON r.query_id = w.intent",
    "q_reply": """SELECT conv_id, turn, concat_ws(' ', CASE WHEN turn = 4 THEN '(following the nudge: be brief)' END, CASE WHEN turn % 2 = 0 THEN 'calling grep(symbol)' END,
  CASE WHEN turn = 5 THEN 'scripted' WHEN turn % 3 = 0 THEN 'from earlier: "' || role || '"' ELSE 'nothing on file about "' || substr(text, 1, 40) || '"' END) AS reply FROM conversations""",
    "q_stream_index": f"WITH t AS (SELECT role AS pool, concat(conv_id, '-', turn) AS id, text FROM conversations), {S.terms('t', 'pool, id', 'text', 'tt')} SELECT pool, id, count(*) AS doc_len, string_agg(term, ' ' ORDER BY pos) AS terms FROM tt GROUP BY pool, id",
    "q_stream_spill": f"SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) x WHERE back > {WINDOW}",
    "q_prompt": f"""WITH {_RECALL}, found AS (WITH {_tools_cte()} SELECT query_id, rank, id FROM ranked), {_tool_lines_cte()}, lu AS (SELECT conv_id, arg_max(text, turn) AS usr, max(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY conv_id),
rl AS (SELECT r.conv_id, string_agg('- ' || c.text, chr(10) ORDER BY r.rank) AS recalled FROM rec r JOIN lu ON lu.conv_id = r.conv_id AND lu.turn = r.turn JOIN conversations c ON c.conv_id = r.conv_id AND c.turn = r.hit_turn GROUP BY r.conv_id),
wl AS (SELECT w.conv_id, string_agg(l.line, chr(10) ORDER BY r.rank) AS tools FROM (SELECT conv_id, {_INTENT.replace('text', 'usr')} AS intent FROM lu) w JOIN found r ON r.query_id = w.intent JOIN lines l ON l.id = r.id GROUP BY w.conv_id)
SELECT lu.conv_id, concat_ws(chr(10) || chr(10), '[system] You are a helpful assistant.', CASE WHEN tools <> '' THEN '[tools available]' || chr(10) || tools END, '[conversation]' || chr(10) || coalesce(l.lines, ''), CASE WHEN recalled <> '' THEN '[recalled memories]' || chr(10) || recalled END, CASE WHEN lu.turn >= 4 THEN '[nudge] Be brief.' END, CASE WHEN usr <> '' THEN '[user] ' || usr END) AS prompt
FROM lu LEFT JOIN {_lines(WINDOW)} l USING (conv_id) LEFT JOIN rl USING (conv_id) LEFT JOIN wl USING (conv_id)""",
    "q_session": f"SELECT conv_id, turn, least(n, {WINDOW}) AS active, greatest(n - {WINDOW}, 0) AS recall, lag(turn, {WINDOW}) OVER (PARTITION BY conv_id ORDER BY turn) AS \"left\" FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) x",
}
