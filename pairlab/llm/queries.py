"""One query per operator over the whole of its table, and SQL where it can state the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlab.llm import divergence, embedding_dedup, language, licenses, lm, mixing, neighbours, packing, passages, prefix_tree, simhash, toxicity, warc
from pairlab.llm.common import read_table, remainder


def op1_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(read_table(spark, sf, "documents"))


def op7_simhash_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf, "documents"))


def op10_source_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf, "documents"))


def op4_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    model = toxicity.fit(docs, labels.where(remainder("doc_id", 4) != 2))
    rows = toxicity.predict(docs, model)
    return rows.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op2_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents")
    rows = language.identify(docs, language.profiles(docs.where(remainder("doc_id", 3) != 1)))
    return rows.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op3_embedding_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read_table(spark, sf, "embeddings"))


def op5_nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    vectors = read_table(spark, sf, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 50 = 0"))


def op9_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return passages.near_passages(read_table(spark, sf, "documents"))


def op8_lm_scores(spark: SparkSession, sf: str) -> DataFrame:
    held_out = "crc32(cast(coalesce(cast(doc_id as string), '') as binary)) % 7 = 2"
    return lm.score_texts(read_table(spark, sf, "documents"), held_out)


def op6_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files of a tree: source, then two levels by id; every tenth id of a directory is its license file."""
    docs = read_table(spark, sf, "documents")
    number = F.coalesce("doc_id", F.lit(0))
    name = F.when(number % 10 == 0, F.lit("LICENSE")).otherwise(F.lit("text"))
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.floor(number / 1000), F.floor(number / 50), F.concat(name, F.lit("."), number))
    return licenses.scan(docs.withColumn("path", path), "doc_id", "path", "text").withColumnRenamed("file", "doc_id")


def op11_source_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return divergence.audit(read_table(spark, sf, "documents"))


def op12_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_tree.prefix_trie(read_table(spark, sf, "conversations"))


def op13_warc_salvage(spark: SparkSession, sf: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf, "pages"))


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op7_simhash_dedup": op7_simhash_dedup,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op2_language_id": op2_language_id,
    "op4_toxicity": op4_toxicity,
    "op6_license_scan": op6_license_scan,
    "op8_lm_scores": op8_lm_scores,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_source_mixing": op10_source_mixing,
    "op11_source_divergence": op11_source_divergence,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_warc_salvage": op13_warc_salvage,
}

SQL: dict[str, str] = {
    "op11_source_divergence": """
        with d as (
            select row_number() over () as doc, coalesce(lang, '') as lang, coalesce(source, '') as source,
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
            from documents
        ),
        words as (
            select doc, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from d
        ),
        kept as (select lang, term, count(*) as lang_n from words group by all having count(distinct doc) >= 30),
        counts as (select lang, source, term, count(*) as n from words join kept using (lang, term) group by all),
        groups as (select distinct lang, source from d),
        langs as (select lang, sum(lang_n) as lang_total, count(*) as v from kept group by lang),
        cells as (
            select lang, source, term, coalesce(n, 0) as n, lang_n, lang_total, v, sum(coalesce(n, 0)) over (partition by lang, source) as total
            from groups join kept using (lang) join langs using (lang) left join counts using (lang, source, term)
        ),
        shares as (
            select lang, source, term, n,
                   cast(1 + (1000000000::hugeint * (n + 5)) // (total + 5 * v) as bigint) as p,
                   cast(1 + (1000000000::hugeint * (lang_n + 5)) // (lang_total + 5 * v) as bigint) as q
            from cells
        ),
        far as (
            select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
            from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
        ),
        both_parts as (
            select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(value, 0) as bigint) as value
            from groups a join groups b on a.lang = b.lang and a.source <> b.source
            left join far f on f.lang = a.lang and f.source = a.source and f.item = b.source
            union all
            select lang, source, 'term', term, p - q from shares where n > 0 and p > q
        ),
        ranked as (
            select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank
            from both_parts
        )
        select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 50""",
    # the check sum of a decimal number, bit by bit, gives the turns taken from the family's first conversation
    "op12_prefix_trie": """
        with turns as (
            select conv_id, row_number() over (partition by conv_id order by turn nulls first) as pos,
                   sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as id,
                   len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as words
            from conversations
        ),
        sums as (
            select distinct conv_id, conv_id - conv_id % 20 as base, list_reduce(
                list_prepend(4294967295::bigint, list_transform(string_split(cast(conv_id as varchar), ''), lambda x: ord(x)::bigint)),
                lambda c, b: list_reduce(
                    list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]),
                    lambda r, i: xor(r >> 1, case when r & 1 = 1 then 3988292384 else 0 end)
                )
            ) as state
            from turns
        ),
        convs as (select conv_id, base, xor(state, 4294967295) % 4 as h from sums),
        rows_ as (
            select conv_id, pos, id, words from convs join turns using (conv_id) where pos > h or base = conv_id
            union all
            select c.conv_id, pos, id, words from convs c join turns t on t.conv_id = c.base where pos <= h and base <> c.conv_id
        ),
        built as (
            select conv_id, coalesce(list(id order by pos) filter (where id is not null), []) as ids,
                   coalesce(list(words order by pos) filter (where id is not null), []) as counts
            from convs left join rows_ using (conv_id) group by conv_id
        ),
        members as (
            select conv_id, len(ids) as len, unnest(range(len(ids) + 1)) as depth, ids, counts from built
        ),
        nodes as (
            select ids[1:depth] as prefix, depth, min(conv_id) as conv_id, count(*) as n_convs,
                   coalesce(max(counts[depth]), 0) as words,
                   sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where len = depth), '')) as ends_sha256
            from members group by all
        ),
        kids as (select prefix[1:depth - 1] as prefix, count(*) as n_children from nodes where depth > 0 group by 1),
        own as (
            select prefix, depth, coalesce(n_children, 0) as n_children, (n_convs - 1) * words as saved from nodes left join kids using (prefix)
        ),
        up as (select prefix[1:a] as prefix, n_children, saved from (select *, unnest(range(depth + 1)) as a from own)),
        below as (select prefix, count(*) filter (where n_children = 0) as n_leaves, cast(sum(saved) as bigint) as saved_tokens from up group by 1)
        select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, o.n_children, n_leaves, saved_tokens, n.ends_sha256
        from nodes n join own o on n.prefix = o.prefix join below b on n.prefix = b.prefix
        left join nodes p on n.depth > 0 and p.prefix = n.prefix[1:n.depth - 1]""",
    "op13_warc_salvage": """
        with p as (
            select page_id, sha256(coalesce(html, '')) as payload_digest, octet_length(encode(coalesce(html, ''))) as payload_bytes
            from pages
        ),
        q as (select *, min(page_id) over (partition by payload_digest, payload_bytes) as first from p)
        select page_id, payload_bytes, payload_digest,
               case when payload_bytes >= 100 and page_id is distinct from first and first is not null then 'revisit' else 'response' end as record_type,
               case when payload_bytes >= 100 and page_id is distinct from first then first end as refers_to
        from q""",
}
