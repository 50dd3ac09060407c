"""Text and graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions.text import FINANCIAL_TERMS, text_features
from riskloom.operators import documents as N
from riskloom.operators import graph as G
from riskloom.plans.registry import case
from riskloom.plans.tables import Tables

WORDS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')"
TOKENS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')"
SENTS = "list_filter(list_transform(regexp_split_to_array(text, '[.!?\\n]+'), lambda s: trim(s)), lambda s: s <> '')"
STOP = ("the", "and", "of", "in", "to", "le", "la", "les", "de", "et")


@case("x9_text_features")
def _(t: Tables):
    return text_features(t.documents.select("doc_id", "source", "text"), ["source", "text"]).drop("text")


@case(
    "m27_tfidf",
    f"""with w as (select doc_id, list_filter({TOKENS}, lambda w: w not in ({", ".join(f"'{s}'" for s in STOP)})) as ws from documents),
    t as (select doc_id, unnest(ws) as term from w union all select doc_id, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) from w),
    c as (select doc_id, term, count(*) as tf from t group by 1, 2), v as (select term, count(*) as docs, sum(tf) as total from c group by 1 having count(*) >= 2 order by total desc, term limit 50),
    r as (select doc_id, c.term, tf * (ln((1 + (select count(*) from documents)) / (1e0 + docs)) + 1) as w from c join v on v.term = c.term)
    select doc_id, term, w / sqrt(sum(w * w) over (partition by doc_id)) as weight from r""",
    r6="weight",
)
def _(t: Tables):
    return N.tfidf(t.documents, "doc_id", "text", stop=STOP)


PHRASES = (("of the", "style", "low"), ("and with", "style", "medium"), ("the for", "style", "high"))


@case(
    "g17_risk_phrases",
    f"""with s as (select doc_id, {SENTS} as ss from documents), p as (select doc_id, ss, unnest(range(0, len(ss))) as pos from s),
    q as (select doc_id, pos, lower(ss[pos + 1]) as low, ' ' || lower(array_to_string(ss[greatest(pos - 1, 1):pos + 3], ' ')) || ' ' as around from p),
    d(phrase, category, severity) as (values {", ".join(str(x) for x in PHRASES)})
    select doc_id, cast(pos as int) as pos, phrase, category, severity, {" or ".join(f"contains(around, '{w}')" for w in N.NEGATIONS)} as negated,
      {" or ".join(f"contains(around, '{w}')" for w in N.CONDITIONS)} as conditional, {" or ".join(f"contains(around, '{w}')" for w in N.HISTORY)} as historical
    from q join d on contains(low, phrase)""",
)
def _(t: Tables):
    return N.risk_phrases(t.documents, "doc_id", "text", PHRASES)


@case(
    "g18_entities",
    " union all ".join(
        f"select doc_id, '{k}' as kind, unnest(regexp_extract_all(text, '{p}')) as value from documents" for k, p in N.ENTITY_PATTERNS.items()
    ),
)
def _(t: Tables):
    return N.entities(t.documents, "doc_id", "text")


@case("g18_specificity", f"""select doc_id, case when len({WORDS}) > 0 then ({" + ".join(f"len(regexp_extract_all(text, '{p}'))" for p in N.ENTITY_PATTERNS.values())}) / cast(len({WORDS}) as double) else 0e0 end as specificity from documents""", r6="specificity")
def _(t: Tables):
    return t.documents.select("doc_id", N.specificity(F.col("text")).alias("specificity"))


@case(
    "g19_readability",
    f"""with b as (select doc_id, cast(len({WORDS}) as int) as words, cast(len({SENTS}) as int) as sentences, cast(len(list_filter({WORDS}, lambda w: length(w) > 6)) as int) as long_words from documents)
    select *, words / nullif(cast(sentences as double), 0) as words_per_sentence, long_words / nullif(cast(words as double), 0) as long_word_share,
      words / nullif(cast(sentences as double), 0) + 100 * (long_words / nullif(cast(words as double), 0)) as lix from b""",
    r6="words_per_sentence long_word_share lix",
)
def _(t: Tables):
    return N.readability(t.documents, "doc_id", "text")


@case(
    "g19_term_density",
    f"""select doc_id, case when len({TOKENS}) > 0 then len(list_filter({TOKENS}, lambda w: w in ({", ".join(f"'{w}'" for w in (*FINANCIAL_TERMS, 'the'))}))) / cast(len({TOKENS}) as double) else 0e0 end as term_density from documents""",
    r6="term_density",
)
def _(t: Tables):
    return N.term_density(t.documents, "doc_id", "text", (*FINANCIAL_TERMS, "the"))


@case("g20_aspect_sentiment")
def _(t: Tables):
    aspects = {"articles": ("the", "le ", "la "), "links": ("and", "et "), **N.ASPECTS}
    return N.aspect_sentiment(t.documents, "doc_id", "text", aspects)


@case(
    "g21_chunk",
    f"""with w as (select doc_id, lang, {WORDS} as ws from documents), c as (select doc_id, lang, ws, unnest(range(0, cast(greatest(ceil((len(ws) - 128) / 384e0), 1) as int))) as chunk from w where len(ws) > 0)
    select doc_id, lang, cast(chunk as int) as chunk, cast(len(ws[chunk * 384 + 1:chunk * 384 + 512]) as int) as tokens, array_to_string(ws[chunk * 384 + 1:chunk * 384 + 512], ' ') as content from c""",
)
def _(t: Tables):
    return N.chunk(t.documents, "doc_id", "text", keep=["lang"])


QUERY = ("the", "and", "with")


@case(
    "g22_bm25",
    f"""with w as (select doc_id, {TOKENS} as ws from documents), c as (select doc_id, len(ws) as len, {", ".join(f"len(list_filter(ws, lambda w: w = '{q}')) as q{i}" for i, q in enumerate(QUERY))} from w),
    s as (select count(*) as n, avg(len) as av, {", ".join(f"count(case when q{i} > 0 then 1 end) as d{i}" for i in range(len(QUERY)))} from c),
    r as (select doc_id, {" + ".join(f"ln(1 + (n - d{i} + 5e-1) / (d{i} + 5e-1)) * q{i} * 25e-1 / (q{i} + 15e-1 * (1 - 75e-2 + 75e-2 * len / av))" for i in range(len(QUERY)))} as score from c, s)
    select doc_id, score from r where score > 0 order by score desc, doc_id limit 10""",
    r6="score",
)
def _(t: Tables):
    return N.bm25(t.documents, "doc_id", "text", QUERY)


def first_vector(t: Tables):
    return [float(x) for x in t.embeddings.where("vec_id = 0").first()["embedding"]]


@case(
    "g22_dense_topk",
    """with q as (select list_transform(embedding, lambda x: x::double) as q from embeddings where vec_id = 0), e as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings)
    select vec_id, list_sum(list_transform(list_zip(v, q), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform(v, lambda x: x * x))) * sqrt(list_sum(list_transform(q, lambda x: x * x)))) as score from e, q order by score desc, vec_id limit 10""",
    r6="score",
)
def _(t: Tables):
    return N.dense_topk(t.embeddings, "vec_id", "embedding", first_vector(t))


@case("g22_hybrid_rank")
def _(t: Tables):
    a = N.bm25(t.documents, "doc_id", "text", QUERY, k=50)
    b = N.dense_topk(t.embeddings.withColumnRenamed("vec_id", "doc_id"), "doc_id", "embedding", first_vector(t), k=50)
    return N.hybrid_rank(a, b, "doc_id")


@case("g23_topics")
def _(t: Tables):
    return N.topics(t.documents, "doc_id", "text", k=3, vocabulary=200, rounds=3)


EDGES = "ed as (select distinct 'm:' || cast(c_custkey as varchar) as src, 'a:' || cast(c_nationkey as varchar) as dst from customer)"


def edges(t: Tables):
    return G.shared_attribute_edges(t.customer, "c_custkey", "c_nationkey")


@case("g16_graph_degree", f"with {EDGES} select node, count(*) as degree from (select src as node, dst as o from ed union select dst, src from ed) z group by node")
def _(t: Tables):
    return G.degree(edges(t))


@case(
    "g16_graph_components",
    f"""with {EDGES} select dst as node, dst as component from ed group by dst union all select src, dst from ed""",
)
def _(t: Tables):
    return G.components(edges(t))


@case(
    "g16_graph_shortest_path",
    f"""with {EDGES}, h as (select dst from ed where src = 'm:7') select 'm:7' as node, 0 as distance union all select dst, 1 from h union all select src, 2 from ed join h on h.dst = ed.dst where src <> 'm:7'""",
)
def _(t: Tables):
    return G.shortest_path(edges(t), "m:7")


# In a star of k members, the rank of the centre c and of a member x follow c' = .15 + .85 k x, x' = .15 + .85 c / k.
@case(
    "g16_graph_pagerank",
    f"""with recursive {EDGES}, k as (select dst, count(*) as k from ed group by dst),
    it as (select dst, k, 0 as i, 1e0 as c, 1e0 as x from k union all select dst, k, i + 1, 15e-2 + 85e-2 * k * x, 15e-2 + 85e-2 * c / k from it where i < 10)
    select dst as node, c as rank from it where i = 10 union all select src, x from it join ed on ed.dst = it.dst where i = 10""",
    r6="rank",
)
def _(t: Tables):
    return G.pagerank(edges(t))


@case("g16_graph_communities")
def _(t: Tables):
    return G.communities(edges(t), rounds=4)
