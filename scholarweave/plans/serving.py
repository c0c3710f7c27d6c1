"""Catalogue: question analysis, contexts, prompts, answers, memory and caches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scholarweave.fixed_values import EMBEDDING_MODELS
from scholarweave.functions import answers, encoding, node_text, prompts, questions
from scholarweave.functions import text as tx
from scholarweave.operators import context, embedding_store, expansion, memory, question_path, session_store
from scholarweave.plans import graph
from scholarweave.session import durable, scratch
from scholarweave.sources import tables as t

# Openings put before the users' own words, so that every kind of question occurs.
OPENINGS = [
    "Who is the most cited author in 2019 after John Smith wrote about ",
    "Compare research trend and change between 2015 and 2020 for battery papers: ",
    "최근 배터리 연구 동향은 무엇인가 machine learning 논문 분석 ",
    "김철수 교수의 SoC 연구 ",
    "List papers by Dr. Mary Jones and J. Miller in the Journal of Power about ",
    "Give a comprehensive overall network analysis of hidden patterns: ",
    "",
]


def asked(spark, d):
    """Users' turns as questions, each behind one of the openings."""
    rows = t.table(spark, d, "conversations").filter("role = 'user'")
    opening = F.element_at(F.array(*[F.lit(o) for o in OPENINGS]), ((F.col("conv_id") + F.col("turn")) % len(OPENINGS) + 1).cast("int"))
    return rows.select("conv_id", "turn", F.concat(opening, "text").alias("question"))


def _joined(df, *names):
    return df.select(*[F.array_join(c, "|").alias(c) if c in names else F.col(c) for c in df.columns])


def query_language(spark, d):
    return questions.with_language(asked(spark, d)).select("conv_id", "turn", "language", "processed")


def query_entities(spark, d):
    rows = questions.with_entities(questions.with_language(asked(spark, d)))
    lists = ("authors", "journals", "institutions", "years", "keywords")
    return _joined(rows.select("conv_id", "turn", *lists), *lists)


def query_complexity(spark, d):
    rows = questions.analyze(asked(spark, d))
    return rows.select("conv_id", "turn", F.round("complexity_score", 6).alias("complexity_score"), "complexity", "suggested_timeout")


def query_type(spark, d):
    return questions.analyze(asked(spark, d)).select("conv_id", "turn", "query_type")


def query_plan(spark, d):
    rows = questions.analyze(asked(spark, d)).withColumn("strategy", expansion.choose_strategy(F.col("complexity"), F.col("query_type"), F.col("search_mode")))
    lists = ("required_node_types", "required_edge_types", "processing_hints", "temporal_indicators")
    return _joined(rows.select("conv_id", "turn", "search_mode", "estimated_scope", "strategy", F.round("confidence", 6).alias("confidence"), *lists), *lists)


def subgraph(spark, d):
    """The local subgraphs of the ten label queries, with what the context needs."""
    nodes, edges, members, found = graph.local_subgraph(spark, d)
    inside = durable(members.select(F.col("node_id").alias("id")).distinct())
    described = durable(graph.described(spark, d, inside)[0])
    scored = durable(expansion.relevance(members, nodes, found))
    asked_for = found.select("query_id").distinct().select(
        "query_id", F.concat(F.lit("papers near "), "query_id").alias("question"), F.lit("en").alias("language"),
        F.array(F.lit("paper")).alias("required_node_types"), F.lit("local").alias("strategy"),
    )
    return described, durable(expansion.induced_edges(members, edges)), scored, expansion.confidence(scored, found), durable(asked_for)


# --- the way of a question, from the users' turns to answers ---------------------------------


def node_label():
    return F.coalesce("title", "name", "id")


def question_corpus(spark, d):
    """The described graph, opened for questions; a node's vector is that of its title or name."""
    nodes, edges = graph.described(spark, d)
    nodes = durable(nodes)
    vectors = nodes.select(F.col("id").alias("node_id"), "node_type", encoding.encode(node_label()).alias("embedding"))
    return question_path.open_corpus(nodes, edges, vectors)


def question_table(spark, d):
    rows = asked(spark, d)
    return rows.select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), "question")


SEEDS = {"k": 5, "min_similarity": 0.2}


def question_seeds(spark, d):
    """Nodes nearest to each question among the types it requires."""
    analysed = durable(question_path.analyse(question_table(spark, d), encoding.encode))
    nodes = graph.named(spark, d).repartition(4 * spark.sparkContext.defaultParallelism, "id")  # encoding and search are bound by CPU
    store = nodes.select(F.col("id").alias("node_id"), "node_type", encoding.encode(node_label()).alias("embedding"))
    return question_path.find_seeds(analysed, durable(store), **SEEDS).select("query_id", "node_id", F.round("similarity", 5).alias("similarity"), "rank")


def question_subgraphs(spark, d):
    """Every question's subgraph: strategy, seeds, sizes and confidence."""
    analysed = durable(question_path.analyse(question_table(spark, d), encoding.encode))
    found = question_path.extract(analysed, question_corpus(spark, d), **SEEDS)
    return found.summary.select("query_id", "strategy", "seeds", "total_nodes", "total_edges", F.round("confidence", 5).alias("confidence"))


def question_documents(spark, d):
    out = question_path.retrieve(question_table(spark, d), question_corpus(spark, d), encoding.encode, **SEEDS)
    return out.select("query_id", "doc_no", "document_type", "node_id", F.round("relevance", 5).alias("relevance"), F.length("content").alias("length"))


def question_answers(spark, d):
    """All users' questions answered in one plan, with a model that repeats the last line but one of its prompt."""

    def make():
        return lambda prompt: prompt.strip().rsplit("\n", 2)[-2] if prompt.count("\n") > 1 else prompt

    out = question_path.ask(question_table(spark, d), question_corpus(spark, d), encoding.encode, make, **SEEDS)
    return out.select("query_id", "strategy", "total_nodes", "total_tokens", F.size("source_nodes").alias("sources"), F.col("error").isNull().alias("answered"))


def embedding_updates(spark, d):
    """Three runs over papers, keywords and journals: all are new; every tenth paper has another title and every seventh is gone; nothing has changed."""
    nodes = durable(graph.described(spark, d)[0].filter("node_type <> 'author'"))
    number = F.regexp_extract("id", "([0-9]+)$", 1).cast("bigint")
    is_paper = F.col("node_type") == "paper"
    later = nodes.filter(~is_paper | (number % 7 != 0)).withColumn("title", F.when(is_paper & (number % 10 == 0), F.concat("title", F.lit(" revised"))).otherwise(F.col("title")))
    path, done = scratch(spark, "embeddings"), []
    for state in (nodes, later, later):
        done.append(embedding_store.update(state, path, encoding.encode, "hashing-64"))
        if len(done) == 2:
            embedding_store.compact(spark, path)
    stored = embedding_store.read_store(spark, path).count()
    rows = [(i + 1, r["encoded"], r["kept"], r["removed"], stored) for i, r in enumerate(done)]
    return spark.createDataFrame(rows, "run int, encoded long, kept long, removed long, stored_at_end long")


def node_priority(spark, d):
    nodes, _, scored, _, asked_for = subgraph(spark, d)
    return context.node_priorities(scored, nodes, asked_for).select("query_id", "node_id", "priority")


def context_totals(spark, d):
    nodes, edges, scored, _, asked_for = subgraph(spark, d)
    return context.context_totals(context.node_priorities(scored, nodes, asked_for), context.edge_priorities(edges, scored))


def store_metadata(spark, d):
    """Papers' lists as a vector store takes them."""
    papers = graph.described(spark, d)[0].filter("node_type = 'paper'").select("id", "node_type", "authors", "keywords")
    return node_text.flat_metadata(papers)


def edge_priority(spark, d):
    _, edges, scored, _, _ = subgraph(spark, d)
    return context.edge_priorities(edges, scored).groupBy("query_id", "edge_type", "priority").agg(F.count("*").alias("edges"))


def sections(spark, d):
    nodes, edges, scored, summary, asked_for = subgraph(spark, d)
    return context.context_sections(scored, nodes, edges, summary, asked_for), scored, nodes


def context_sections(spark, d):
    return sections(spark, d)[0]


def token_budget(spark, d):
    kept = context.fit_budget(durable(sections(spark, d)[0]), 1500)
    return kept.select("query_id", "section", tx.token_estimate(F.col("text")).alias("tokens"))


def context_text(spark, d):
    return context.serialize(durable(sections(spark, d)[0]), 8000).select("query_id", "total_tokens", F.round("compression_ratio", 6).alias("compression_ratio"), "mixed_language")


def docs_ranked(spark, d):
    parts, scored, nodes = sections(spark, d)
    out = context.documents(context.serialize(durable(parts), 2000), scored, nodes)
    return out.select("query_id", "doc_no", "document_type", "node_id", F.round("relevance", 6).alias("relevance"), F.length("content").alias("length"))


def prompt_build(spark, d):
    rows = questions.analyze(asked(spark, d))
    lang, kind, level = F.col("language"), F.col("query_type"), F.col("complexity")
    full = prompts.fill(prompts.specific_prompt(lang, kind, level, F.col("confidence")), F.lit("CONTEXT"), F.col("question"))
    chat = prompts.chat_prompt(lang, kind, level)
    return rows.select("conv_id", "turn", F.length(full).alias("prompt_length"), F.length(chat["system"]).alias("system_length"), chat["human"].alias("human"))


def qa_prompt(spark, d):
    rows = t.table(spark, d, "documents").select("doc_id", prompts.qa_prompt(F.concat(F.lit("What is "), "source"), F.col("text")).alias("p"))
    return rows.select("doc_id", F.length("p").alias("length"), F.md5(F.col("p").cast("binary")).alias("digest"))


def answer_cleanup(spark, d):
    rows = t.table(spark, d, "conversations").filter("role = 'assistant'")
    noisy = F.concat("text", F.lit(" aaaaaaaaaa yes yes yes yes"))
    return rows.select("conv_id", "turn", F.md5(answers.clean_answer(noisy).cast("binary")).alias("digest"), F.length(answers.post_process(noisy)).alias("length"))


def meaningless_filter(spark, d):
    rows = t.table(spark, d, "conversations")
    return rows.select("conv_id", "turn", answers.is_meaningless(F.col("text")).alias("meaningless"), answers.is_meaningless(F.regexp_replace("text", r"[\p{L} ]", "")).alias("stripped"))


def answer_run(spark, d):
    """Generation seam with a model that answers in upper case and fails on texts with digits."""

    def make():
        def model(prompt):
            if any(c.isdigit() for c in prompt):
                raise ValueError("memory")
            return prompt.upper()

        return model

    rows = t.table(spark, d, "conversations").select("conv_id", "turn", "text")
    return answers.run_summary(answers.generate(rows, "text", make))


def node_texts(spark, d):
    return node_text.with_node_text(graph.unified_nodes(spark, d)).select("id", "node_type", F.md5(F.col("text").cast("binary")).alias("digest"))


def turns(spark, d):
    """A user's turn with the assistant's next one, empty where none follows; relevance and keywords follow from the text."""
    c = t.table(spark, d, "conversations")
    # read backwards, so that the next answer is a running value
    later = Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role").rowsBetween(Window.unboundedPreceding, -1)
    answer = F.last(F.when(F.col("role") == "assistant", F.col("text")), ignorenulls=True).over(later)
    rows = c.select("conv_id", "turn", "role", F.col("text").alias("human"), F.coalesce(answer, F.lit("")).alias("ai")).filter("role = 'user'")
    return rows.select(
        F.concat_ws("-", F.lit("s"), F.col("conv_id") % 7).alias("session_id"),
        (F.col("conv_id") * 100 + F.col("turn")).alias("turn"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60).alias("ts"),
        memory.turn_tokens(F.col("human"), F.col("ai")).alias("tokens"),
        (F.length("human") % 100 / 100.0).alias("relevance"),
        F.slice(F.split("human", " "), 1, 4).alias("keywords"),
    )


def _kept(df):
    return df.select("session_id", "turn")


def memory_fifo(spark, d):
    return _kept(memory.keep_recent(turns(spark, d)))


def memory_relevance(spark, d):
    return _kept(memory.keep_relevant(turns(spark, d), F.timestamp_seconds(F.lit(1704844800))))


def memory_frequency(spark, d):
    return _kept(memory.keep_frequent(turns(spark, d)))


def memory_hybrid(spark, d):
    return _kept(memory.keep_hybrid(turns(spark, d)))


def memory_window(spark, d):
    return _kept(memory.last_turns(turns(spark, d), 10))


def memory_kinds(spark, d):
    """What each session shows by its kind of memory; the kinds go round."""
    rows = turns(spark, d)
    kinds = ["buffer", "window", "summary", "summary_buffer", "graphrag_enhanced", "other"]
    at = F.regexp_extract("session_id", "([0-9]+)$", 1).cast("int")
    named = rows.select("session_id").distinct().select("session_id", F.element_at(F.array(*[F.lit(k) for k in kinds]), at % len(kinds) + 1).alias("memory_type"))
    return _kept(memory.select_memory(rows, named))


def kept_histories(spark, d):
    """All turns go to a store in two parts, after the first of which one session is cleared; read back after compaction."""
    rows, path = durable(turns(spark, d)), scratch(spark, "histories")
    first = F.col("turn") % 100 < 2
    session_store.append_turns(rows.filter(first), path)
    session_store.clear_sessions(rows.filter("session_id = 's-3'"), path)
    session_store.append_turns(rows.filter(~first), path)
    session_store.compact(spark, path)
    return session_store.read_histories(spark, path).select("session_id", "turn", "tokens", F.unix_seconds("ts").alias("at"), F.array_join("keywords", "|").alias("keywords"))


def memory_check(spark, d):
    return memory.needs_compression(turns(spark, d))


def memory_stats(spark, d):
    out = memory.memory_stats(turns(spark, d))
    return out.select("session_id", "total_turns", "total_tokens", F.unix_seconds("oldest").alias("oldest"), F.unix_seconds("newest").alias("newest"))


def session_summary(spark, d):
    return memory.session_summary(turns(spark, d))


def cache_ttl(spark, d):
    e = t.table(spark, d, "events").select(F.concat_ws("-", "user_id", "event_type").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("value"))
    now = e.select(F.max("ts")).scalar()
    return memory.cache_state(e, now, 24 * 3600, 50).select("key", "value")


def usage_stats(spark, d):
    e = t.table(spark, d, "events").select(
        F.get_json_object("props", "$.k").cast("bigint").alias("tokens"), F.col("value").alias("seconds"),
        (F.col("event_type") == "view").alias("cached"), (F.col("event_type") == "error").alias("failed"),
    )
    return memory.usage_stats(e)


QUERIES = {
    f.__name__: f
    for f in (
        query_language, query_entities, query_complexity, query_type, query_plan, node_priority, edge_priority, context_totals, store_metadata, context_sections,
        token_budget, context_text, docs_ranked, prompt_build, qa_prompt, answer_cleanup, meaningless_filter, answer_run, node_texts,
        memory_fifo, memory_relevance, memory_frequency, memory_hybrid, memory_window, memory_kinds, kept_histories, memory_check, memory_stats,
        session_summary, cache_ttl, usage_stats, question_seeds, question_subgraphs, question_documents, question_answers, embedding_updates,
    )
}

from scholarweave.plans.serving_sql import SQL  # noqa: E402, F401
