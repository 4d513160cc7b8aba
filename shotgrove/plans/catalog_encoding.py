"""Prompts, token features and the vocabulary."""

from pyspark.sql import functions as F

from shotgrove.functions import text as X
from shotgrove.operators import encoding as N
from shotgrove.operators import knn, neighbors, vocab
from shotgrove.plans.catalog_examples import SQL_VOCAB, document_vocab
from shotgrove.plans.inputs import (
    SQL_TOKENS, quality_examples, turn_examples, vectors, with_parts)
from shotgrove.plans.registry import joined, query, rounded, table
from shotgrove.tasks import task

_SINGLE, _PAIR = task("sst-2").template, task("mnli").template


def _lower(x):
    return f"lower(left({x}, 1)) || substring({x}, 2)"


def _upper(x):
    return f"upper(left({x}, 1)) || substring({x}, 2)"


def _short(x):
    return f"left({x}, greatest(length({x}) - 1, 0))"


_SQL_SINGLE = "'<s>' || text_a || ' It was' || '<mask>' || '.' || '</s>'"
_SQL_PAIR = f"'<s>' || {_short('text_a')} || '?' || '<mask>' || ',' || ' ' || {_lower('text_b')} || '</s>'"


@query("render_prompt", with_parts("quality", "turns") + f"""
    SELECT task, guid, {_SQL_SINGLE} AS prompt FROM quality
    UNION ALL SELECT task, guid, {_SQL_PAIR} AS prompt FROM turns""")
def render_prompt(spark, folder):
    both = quality_examples(spark, folder).unionByName(turn_examples(spark, folder))
    return N.render_prompts(both, {"quality": _SINGLE, "turns": _PAIR}).select("task", "guid", "prompt")


_FORMS = ("sent_0", "+sent_0", "sent-_0", "sentl_0", "+sentl_0", "sentl-_0", "sentu_0", "+sentu_0")
_SQL_FORMS = ["text_a", "' ' || text_a", _short("text_a"), _lower("text_a"), "' ' || " + _lower("text_a"),
              _short("(" + _lower("text_a") + ")"), _upper("text_a"), "' ' || " + _upper("text_a")]


@query("render_variants", with_parts("quality") + "\n    SELECT guid, " + ", ".join(
    f"{sql} AS form_{i}" for i, sql in enumerate(_SQL_FORMS)) + " FROM quality")
def render_variants(spark, folder):
    rows = quality_examples(spark, folder)
    for i, form in enumerate(_FORMS):
        rows = N.render_prompts(rows, {"quality": f"*{form}*"}).withColumnRenamed("prompt", f"form_{i}")
    return rows.select("guid", *[f"form_{i}" for i in range(len(_FORMS))])


def sql_knn(k: int, metric: str = "ip", name: str = "knn") -> str:
    """Exact neighbours among all vectors as a common table expression."""
    score = {"ip": "list_inner_product(q.e, d.e)", "cosine": "list_cosine_similarity(q.e, d.e)",
             "l2": "-list_distance(q.e, d.e)"}[metric]
    return f"""{name} AS (
    SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
            SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round({score}, 6) + 0.0 AS score FROM v q CROSS JOIN v d))
    WHERE rank <= {k})"""


_RETRIEVED = "*cls**ret_0*_*sent_0*_It_was*mask*.*sep+*"


@query("render_retrieval", with_parts("v") + ",\n" + sql_knn(3) + """,
    texts AS (SELECT k.query_id, string_agg(d.text, ' ' ORDER BY k.rank DESC) AS passages
              FROM knn k JOIN documents d ON d.doc_id = k.doc_id GROUP BY k.query_id)
    SELECT d.doc_id, '<s>' || COALESCE(t.passages, '') || ' ' || COALESCE(d.text, '') || ' It was<mask>.</s>' AS prompt
    FROM documents d LEFT JOIN texts t ON t.query_id = d.doc_id""")
def render_retrieval(spark, folder):
    """All documents; those without a vector have no passages."""
    corpus = table(spark, folder, "documents").select("doc_id", "text")
    queries = vectors(spark, folder, "query_id").select(
        "query_id", F.col("query_id").alias("guid"), F.lit(0).alias("sent_id"), "emb")
    hits = knn.knn_exact(queries, vectors(spark, folder), 3)
    texts = neighbors.texts_by_sentence(neighbors.neighbor_rows(queries, hits, corpus))
    examples = corpus.select("doc_id", F.lit("quality").alias("task"), F.col("text").alias("text_a"),
                             F.lit(None).cast("string").alias("text_b"))
    known = examples.join(texts, F.col("doc_id") == F.col("guid"), "left")
    return N.render_prompts(known, {"quality": _RETRIEVED}, [F.get("retrieved", F.lit(0))]).select("doc_id", "prompt")


# Tokens and segments of the prompts, before their length is fixed.
def _pieces(first: int | None, other: int | None) -> str:
    a = SQL_TOKENS.format(f"({_short('text_a')})")
    b = SQL_TOKENS.format(f"(' ' || {_lower('text_b')})")
    a, b = (f"({x})[1:{n}]" if n else x for x, n in ((a, first), (b, other)))
    return f"list_concat(list_concat(['<s>'], {a}), list_concat(['?', '<mask>', ','], list_concat({b}, ['</s>'])))"


_SINGLE_PIECES = ("list_concat(list_concat(['<s>'], " + SQL_TOKENS.format("text_a")
                  + "), ['It', 'was', '<mask>', '.', '</s>'])")


def _fixed(tokens: str, n: int, head: bool = False) -> str:
    cut = f"list_concat(['<s>'], {tokens}[-{n - 1}:])" if head else f"{tokens}[1:{n}]"
    pad = f"list_concat({tokens}, list_transform(range(greatest({n} - len({tokens}), 0)), lambda i: '<pad>'))"
    return f"CASE WHEN len({tokens}) > {n} THEN {cut} ELSE {pad} END"


def _features(spark, folder, n=128, head=False):
    return N.fix_length(N.prompt_tokens(quality_examples(spark, folder), _SINGLE), n, head)


def _sql_features(select: str, n: int = 128, head: bool = False) -> str:
    return with_parts("quality") + f""",
    raw AS (SELECT guid, label, {_SINGLE_PIECES} AS t FROM quality),
    f AS (SELECT guid, label, len(t) AS n, {_fixed('t', n, head)} AS tokens FROM raw)
    SELECT {select} FROM f"""


@query("sentence_limits", with_parts("turns") + f"""
    SELECT guid, array_to_string({_pieces(20, 10)}, ' ') AS tokens FROM turns""")
def sentence_limits(spark, folder):
    return N.prompt_tokens(turn_examples(spark, folder), _PAIR, 20, 10).select("guid", joined("_tokens").alias("tokens"))


_THREE = "*cls**sent_0**sep+**mask*.*sep+**+sentl_1**sep+*"


@query("segment_ids", with_parts("turns") + f"""
    SELECT guid, rtrim(repeat('0 ', 2 + len({SQL_TOKENS.format('text_a')})) || repeat('1 ', 3)
                       || repeat('2 ', 1 + len({SQL_TOKENS.format("(" + _lower('text_b') + ")")}))) AS segment_ids
    FROM turns""")
def segment_ids(spark, folder):
    return N.prompt_tokens(turn_examples(spark, folder), _THREE).select("guid", joined("_segments").alias("segment_ids"))


@query("attention_mask", _sql_features(
    "guid, rtrim(repeat('1 ', least(n, 128)) || repeat('0 ', greatest(128 - n, 0))) AS attention_mask"))
def attention_mask(spark, folder):
    return _features(spark, folder).select("guid", joined("attention_mask").alias("attention_mask"))


@query("pad_to_length", _sql_features("guid, array_to_string(tokens, ' ') AS tokens, len(tokens)::INTEGER AS n", 2048))
def pad_to_length(spark, folder):
    return _features(spark, folder, 2048).select("guid", joined("tokens").alias("tokens"), F.size("tokens").alias("n"))


@query("truncate_tail", _sql_features("guid, array_to_string(tokens, ' ') AS tokens, (n > 128)::INTEGER AS truncated"))
def truncate_tail(spark, folder):
    return _features(spark, folder).select(
        "guid", joined("tokens").alias("tokens"), F.col("truncated").cast("int").alias("truncated"))


@query("truncate_head", _sql_features(
    "guid, array_to_string(tokens, ' ') AS tokens, (n > 128)::INTEGER AS truncated", head=True))
def truncate_head(spark, folder):
    return _features(spark, folder, head=True).select(
        "guid", joined("tokens").alias("tokens"), F.col("truncated").cast("int").alias("truncated"))


@query("mask_position", _sql_features("guid, (COALESCE(list_position(tokens, '<mask>'), 0) - 1)::INTEGER AS mask_pos"))
def mask_position(spark, folder):
    return _features(spark, folder).select("guid", "mask_pos")


@query("encode_plain", with_parts("quality", "turns") + f""",
    both_kinds AS (SELECT * FROM quality UNION ALL SELECT * FROM turns),
    raw AS (SELECT task, guid, list_concat(list_concat(['<s>'], {SQL_TOKENS.format('text_a')}), list_concat(['</s>'],
                   CASE WHEN text_b IS NULL THEN [] ELSE list_concat({SQL_TOKENS.format('text_b')}, ['</s>']) END)) AS t
            FROM both_kinds)
    SELECT task, guid, array_to_string({_fixed('t', 256)}, ' ') AS tokens FROM raw""")
def encode_plain(spark, folder):
    both = quality_examples(spark, folder).unionByName(turn_examples(spark, folder))
    fixed = N.fix_length(N.plain_tokens(both), 256, segments=False, prompt=False)
    return fixed.select("task", "guid", joined("tokens").alias("tokens"))


@query("encode_features", with_parts("turns") + f""",
    raw AS (SELECT guid, label, {_pieces(110, 50)} AS t FROM turns),
    f AS (SELECT guid, label, len(t) AS n, {_fixed('t', 256)} AS tokens FROM raw)
    SELECT guid, label, array_to_string(tokens, ' ') AS tokens, n::INTEGER AS n_tokens, (n > 256)::INTEGER AS truncated,
           (list_position(tokens, '<mask>') - 1)::INTEGER AS mask_pos FROM f""")
def encode_features(spark, folder):
    rows = N.prompt_tokens(turn_examples(spark, folder), _PAIR, 110, 50)
    features = N.require_mask(N.fix_length(rows, task("mnli").max_length))
    return features.select("guid", "label", joined("tokens").alias("tokens"), "n_tokens",
                           F.col("truncated").cast("int").alias("truncated"), "mask_pos")


@query("token_type_gate", with_parts("turns") + f""",
    n AS (SELECT guid, 2 + len({SQL_TOKENS.format('text_a')}) AS a, 1 + len({SQL_TOKENS.format('text_b')}) AS b
          FROM turns)
    SELECT guid, g.gate, CASE WHEN g.gate = 'on' THEN greatest(0, least(a + b, 64) - a) END::INTEGER AS second_tokens,
           CASE WHEN g.gate = 'on' THEN 64 ELSE 0 END AS n_segment_ids
    FROM n CROSS JOIN (VALUES ('on'), ('off')) AS g(gate)""")
def token_type_gate(spark, folder):
    """Features with the segment column, and for encoders without segments without it."""
    rows = N.plain_tokens(turn_examples(spark, folder))

    def features(gate):
        made = N.fix_length(rows, 64, segments=gate == "on", prompt=False)
        ids = F.col("segment_ids") if "segment_ids" in made.columns else F.lit(None).cast("array<int>")
        return made.select("guid", F.lit(gate).alias("gate"),
                           F.aggregate(ids, F.lit(0), lambda n, s: n + s).alias("second_tokens"),
                           F.coalesce(F.size(ids), F.lit(0)).alias("n_segment_ids"))

    return features("on").unionByName(features("off"))


@query("input_text_echo", with_parts("quality", "turns") + """
    SELECT guid, concat_ws(' ', text_a, text_b) AS input_text
    FROM (SELECT * FROM quality UNION ALL SELECT * FROM turns)""")
def input_text_echo(spark, folder):
    both = quality_examples(spark, folder).unionByName(turn_examples(spark, folder))
    return both.select("guid", F.array_join(X.text_list(F.col("text_a"), F.col("text_b")), " ").alias("input_text"))


@query("build_vocab", f"WITH {SQL_VOCAB} SELECT token, n::BIGINT AS n, token_id::BIGINT AS token_id FROM vocab")
def build_vocab(spark, folder):
    return document_vocab(spark, folder)


_SQL_ENCODED = f"""WITH {SQL_VOCAB},
    pieces AS (SELECT conv_id, turn, unnest({SQL_TOKENS.format('text')}) AS token,
                      generate_subscripts({SQL_TOKENS.format('text')}, 1) AS pos FROM conversations),
    coded AS (SELECT p.conv_id, p.turn, p.pos, COALESCE(v.token_id, 3) AS token_id
              FROM pieces p LEFT JOIN vocab v ON v.token = p.token)"""


def _turn_tokens(spark, folder):
    return table(spark, folder, "conversations").select(
        F.struct("conv_id", "turn").alias("guid"), X.tokens(F.col("text")).alias("tokens"))


@query("encode_ids", _SQL_ENCODED + """
    SELECT conv_id, turn, string_agg(token_id, ' ' ORDER BY pos) AS ids FROM coded GROUP BY conv_id, turn""")
def encode_ids(spark, folder):
    # A small head, so that both ways of the lookup take part.
    words = vocab.stored_vocab(document_vocab(spark, folder))
    coded = vocab.encode_ids(_turn_tokens(spark, folder), words, head_rows=500)
    return coded.select("guid.conv_id", "guid.turn", joined("ids").alias("ids"))


@query("decode_ids", _SQL_ENCODED + """
    SELECT c.conv_id, c.turn, string_agg(v.token, ' ' ORDER BY c.pos) AS text
    FROM coded c JOIN vocab v ON v.token_id = c.token_id GROUP BY c.conv_id, c.turn""")
def decode_ids(spark, folder):
    words = vocab.stored_vocab(document_vocab(spark, folder))
    coded = vocab.encode_ids(_turn_tokens(spark, folder), words)
    return vocab.decode_ids(coded, words, head_rows=500).select("guid.conv_id", "guid.turn", "text")


@query("span_query", f"""
    SELECT conv_id, turn, array_to_string({SQL_TOKENS.format('text')}[turn + 1:turn + 8], ' ') AS query
    FROM conversations""")
def span_query(spark, folder):
    rows = table(spark, folder, "conversations").withColumn("tokens", X.tokens(F.col("text")))
    begin = F.col("turn").cast("int")
    return vocab.span_query(rows, begin, begin + 8).select("conv_id", "turn", "query")


@query("token_stats", _sql_features("""label, COUNT(*) AS n_rows, SUM(least(n, 128))::BIGINT AS n_tokens,
    round(AVG((n > 128)::INTEGER), 6) AS truncated_share,
    round(1 - SUM(least(n, 128)) / SUM(len(tokens)), 6) + 0.0 AS padding_share""") + " GROUP BY label")
def token_stats(spark, folder):
    stats = N.token_stats(_features(spark, folder), ["label"])
    return stats.select("label", "n_rows", "n_tokens", rounded("truncated_share").alias("truncated_share"),
                        rounded("padding_share").alias("padding_share"))
