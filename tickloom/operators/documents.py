"""Document retrieval by spreading activation over a chunk / entity graph, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.num import div
from tickloom.session import materialize

UNICODE = "(?U)"  # word boundaries and spaces as in Unicode, whatever the Java version
# Fixed value: the pattern of entity phrases.
PHRASE = r"\b[A-Z][a-zA-Z0-9&-]+(?:\s+[A-Z][a-zA-Z0-9&-]+){0,2}\b"
# Single words that are never entities.
NOT_ENTITIES = ["The", "This", "That", "With", "From", "Into", "And", "For", "A", "An"]
# Phrases that are never entities in any case.
NOT_PHRASES = ["the", "and", "for"]
# Words in a chunk and words shared with the next, entities of a chunk, least similarity that passes activation, least activation of the context.
CHUNK_WORDS, CHUNK_OVERLAP, MAX_ENTITIES, MIN_SIMILARITY, MIN_ACTIVATION = 500, 200, 6, 0.4, 0.5
TOKEN = "[a-z0-9_]{2,}"
# Commonest terms whose idf is broadcast; the others are joined.
HEAD_TERMS = 50_000


def chunks(docs: DataFrame, size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Overlapping word windows of each document."""
    step = max(1, size - overlap)
    words = docs.select("doc_id", F.filter(F.split(F.col("text"), UNICODE + r"\s+"), lambda w: w != "").alias("w"))
    starts = F.sequence(F.lit(0), F.size("w") - 1, F.lit(step))
    one = words.filter(F.size("w") > 0).select("doc_id", "w", F.posexplode(starts).alias("chunk_no", "at"))
    return one.select("doc_id", "chunk_no", F.concat("doc_id", F.lit("_"), "chunk_no").alias("chunk_id"), F.concat_ws(" ", F.slice("w", F.col("at") + 1, F.lit(size))).alias("text"))


def entities(ch: DataFrame, cap: int = MAX_ENTITIES) -> DataFrame:
    """Capitalised phrases in first-seen order, at most ``cap`` per chunk; else the three most frequent longer words."""
    phrases = F.filter(F.regexp_extract_all("text", F.lit(UNICODE + PHRASE), F.lit(0)), lambda p: ~p.isin(NOT_ENTITIES) & ~F.lower(p).isin(NOT_PHRASES))
    words = F.regexp_extract_all(F.lower("text"), F.lit(UNICODE + r"\b[a-zA-Z]{4,}\b"), F.lit(0))
    df = ch.select("doc_id", "chunk_no", "chunk_id", "text", F.slice(F.array_distinct(phrases), 1, cap).alias("p"), words.alias("_w"))
    # outer: a filter on the list, or one inferred from an inner explode, would search each text a second time
    found = df.select("doc_id", "chunk_no", "chunk_id", "text", F.posexplode_outer("p").alias("pos", "entity")).filter("entity is not null")
    # words are counted by chunk id alone; the text joins what is left of them
    rare = df.filter(F.size("p") == 0)
    freq = rare.select("chunk_id", F.posexplode("_w").alias("i", "word")).groupBy("chunk_id", "word").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("first"))
    rank = Window.partitionBy("chunk_id").orderBy(F.col("n").desc(), "first")
    top = freq.withColumn("pos", F.row_number().over(rank) - 1).filter("pos < 3").select("chunk_id", "pos", F.initcap("word").alias("entity"))
    fallback = rare.select("doc_id", "chunk_no", "chunk_id", "text").join(top, "chunk_id").select("doc_id", "chunk_no", "chunk_id", "text", "pos", "entity")
    return found.unionByName(fallback)


def describe(entity: Column, text: Column) -> Column:
    """First sentence with the entity, else the first 200 characters."""
    hit = F.try_element_at(F.filter(F.split(text, "[.!?]"), lambda s: s.contains(entity)), F.lit(1))
    return F.concat(entity, F.lit(": "), F.coalesce(F.trim(hit), F.substring(text, 1, 200)))


def described(ent: DataFrame) -> DataFrame:
    """Entities with their own sentence in place of the chunk's text, which would be written once per entity."""
    return ent.withColumn("description", describe(F.col("entity"), F.col("text"))).drop("text")


def entity_descriptions(ent: DataFrame) -> DataFrame:
    """Description of every entity from the first chunk that mentions it; a task sends one sentence per entity."""
    ent = ent if "description" in ent.columns else described(ent)
    return ent.groupBy("entity").agg(F.min(F.struct("doc_id", "chunk_no", "description")).alias("at")).select("entity", "at.description")


def links(ent: DataFrame, sentences: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(desc(entity, description), mentions(chunk_id, entity, n), pairs(a < b, n)): what all edges are made of, once each and without prefixes.

    ``sentences``: where descriptions are taken from, if ``ent`` is written without texts.
    """
    mentions = ent.groupBy("chunk_id", "entity").agg(F.count(F.lit(1)).alias("n"))
    # entities per chunk are capped, so the pairs of a chunk are bounded
    listed = ent.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("pos", "entity"))).alias("e"))
    pair = listed.select(F.explode("e").alias("x"), "e").select("x", F.explode(F.filter("e", lambda y: y["pos"] > F.col("x.pos"))).alias("y"))
    pairs = pair.groupBy(F.least("x.entity", "y.entity").alias("a"), F.greatest("x.entity", "y.entity").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return entity_descriptions(ent if sentences is None else sentences), mentions, pairs


def edges_of(desc: DataFrame, mentions: DataFrame, pairs: DataFrame) -> DataFrame:
    """edges(src, dst, text, n) in both directions, ``n`` counts repeats."""
    node = lambda kind, c: F.concat(F.lit(f"{kind}:"), c)
    mention = mentions.select(node("chunk", "chunk_id").alias("a"), node("entity_desc", "entity").alias("b"), F.concat(F.lit("mentions "), "entity").alias("text"), "n")
    about = desc.select(node("entity", "entity").alias("a"), node("entity_desc", "entity").alias("b"), F.concat(F.lit("description of "), "entity").alias("text"), F.lit(1).cast("bigint").alias("n"))
    differ = pairs.filter("a < b").select(node("entity_desc", "a").alias("a"), node("entity_desc", "b").alias("b"), F.lit("co_occurs").alias("text"), "n")
    # chunks that share an id may pair an entity with itself: one edge, counted both ways
    loop = pairs.filter("a = b").select(node("entity_desc", "a").alias("src"), node("entity_desc", "b").alias("dst"), F.lit("co_occurs").alias("text"), (2 * F.col("n")).alias("n"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))))
    return mention.unionByName(about).unionByName(differ).select(ways.alias("w"), "text", "n").select("w.src", "w.dst", "text", "n").unionByName(loop)


def texts_of(ch: DataFrame, desc: DataFrame, mentions: DataFrame, pairs: DataFrame) -> DataFrame:
    """(text, m): every text of a node or edge with its multiplicity; a text may come in several rows."""
    return ch.select("text", F.lit(1).cast("bigint").alias("m")).unionByName(link_texts(desc, mentions, pairs))


def link_texts(desc: DataFrame, mentions: DataFrame, pairs: DataFrame) -> DataFrame:
    """The texts of ``texts_of`` without those of chunks; whatever is compared with a query is among them."""
    one = F.lit(1).cast("bigint").alias("m")
    both = lambda n: (2 * F.sum(n)).alias("m")  # an edge counts in either direction
    parts = [desc.select(F.col("entity").alias("text"), one), desc.select(F.col("description").alias("text"), one),
             mentions.groupBy(F.concat(F.lit("mentions "), "entity").alias("text")).agg(both("n")),
             desc.select(F.concat(F.lit("description of "), "entity").alias("text"), F.lit(2).cast("bigint").alias("m")),
             pairs.agg(both("n")).filter("m is not null").select(F.lit("co_occurs").alias("text"), "m")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def tokens(text: str = "text") -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def inverse_frequencies(texts: DataFrame) -> DataFrame:
    """idf(term, df, idf), smoothed, from texts with multiplicities; terms are counted where they are read."""
    df = texts.select("m", F.explode_outer(F.array_distinct(tokens())).alias("term")).filter("term is not null").groupBy("term").agg(F.sum("m").alias("df"))
    total = materialize(texts.agg(F.sum("m").alias("n_texts")))
    return materialize(df).join(F.broadcast(total)).select("term", "df", (F.log((1.0 + F.col("n_texts")) / (1.0 + F.col("df"))) + 1).alias("idf"))


def postings(texts: DataFrame, idf: DataFrame, head: int = HEAD_TERMS) -> list[DataFrame]:
    """Parts of (text_key, term, x): tf times idf of every term of every distinct text.

    The texts move once, to be counted once each; the term counts of a text then stay in its task. The ``head`` commonest terms
    meet their idf by broadcast, the others, if there are any, by a join on the term.
    """
    once = texts.groupBy(F.xxhash64("text").alias("text_key")).agg(F.min("text").alias("text"))
    tf = once.select("text_key", F.explode_outer(tokens()).alias("term")).filter("term is not null").groupBy("text_key", "term").agg(F.count(F.lit(1)).alias("tf"))
    x = (F.col("tf") * F.col("idf")).alias("x")
    if idf.limit(head + 1).count() <= head:
        return [tf.join(F.broadcast(idf), "term").select("text_key", "term", x)]
    common = materialize(idf.orderBy(F.col("df").desc(), "term").limit(head))
    rare = idf.join(F.broadcast(common.select("term")), "term", "left_anti")
    left = tf.join(F.broadcast(common.select("term")), "term", "left_anti")
    return [tf.join(F.broadcast(common), "term").select("text_key", "term", x), left.join(rare, "term").select("text_key", "term", x)]


def _summed(parts: list[DataFrame], **aggs: Column) -> DataFrame:
    """Sums by text over the parts; each part is summed by itself first, the head inside its tasks."""
    one = [p.groupBy("text_key").agg(*[a.alias(n) for n, a in aggs.items()]) for p in parts]
    return one[0] if len(one) == 1 else one[0].unionByName(one[1]).groupBy("text_key").agg(*[F.sum(n).alias(n) for n in aggs])


def tfidf(texts: DataFrame, idf: DataFrame, head: int = HEAD_TERMS) -> DataFrame:
    """weights(text_key, term, weight) with L2 norm.

    Edge texts repeat millions of times, so each distinct text is embedded once and counted with its multiplicity. Texts move once and
    postings of rare terms twice, to their term and back to their text; there both parts meet, one list per text, which its length bounds.
    """
    x = F.col("x")
    packed = [p.groupBy("text_key").agg(F.collect_list(F.struct("term", "x")).alias(f"p{i}"), F.sum(x * x).alias(f"sq{i}")) for i, p in enumerate(postings(texts, idf, head))]
    both = packed[0].select("text_key", F.col("p0").alias("p"), F.col("sq0").alias("sq"))
    if len(packed) > 1:
        listed, squared = ([F.coalesce(f"{n}{i}", e) for i in (0, 1)] for n, e in (("p", F.array()), ("sq", F.lit(0.0))))
        both = packed[0].join(packed[1], "text_key", "full").select("text_key", F.concat(*listed).alias("p"), (squared[0] + squared[1]).alias("sq"))
    return both.select("text_key", "sq", F.explode("p").alias("p")).select("text_key", "p.term", div("p.x", F.sqrt("sq")).alias("weight"))


def query_vector(query: DataFrame, idf: DataFrame) -> DataFrame:
    """Normalised weights of the query terms known to the index; ``query`` has one ``text``."""
    tf = query.select(F.explode(tokens()).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("tf"))
    raw = idf.join(F.broadcast(tf), "term").select("term", (F.col("tf") * F.col("idf")).alias("x"))
    n = raw.agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("len"))
    return raw.join(F.broadcast(n)).select("term", div("x", "len").alias("q"))


def similarities(texts: DataFrame, idf: DataFrame, qv: DataFrame, head: int = HEAD_TERMS) -> DataFrame:
    """Cosine of every text that shares a term with the query: norm and product in one pass, no weight is written."""
    parts = [p.join(F.broadcast(qv), "term", "left") for p in postings(texts, idf, head)]
    s = _summed(parts, sq=F.sum(F.col("x") * F.col("x")), dot=F.sum(F.col("x") * F.col("q")))
    return s.filter("dot is not null").select("text_key", div("dot", F.sqrt("sq")).alias("cos"))


def seeds(desc: DataFrame, sims: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` descriptions most similar to the query, as nodes."""
    keyed = desc.select(F.concat(F.lit("entity_desc:"), "entity").alias("id"), F.xxhash64("description").alias("text_key"))
    scored = keyed.join(sims, "text_key", "left").select("id", F.coalesce("cos", F.lit(0.0)).alias("score"))
    return scored.orderBy(F.round("score", 9).desc(), "id").limit(k)


def n_hop(start: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """Nodes within ``hops`` of the start nodes, with their distance."""
    seen = materialize(start.select("id", F.lit(0).alias("hop")))
    frontier = seen
    for h in range(1, hops + 1):
        near = F.broadcast(frontier) if h == 1 else frontier  # the start is a handful of seeds
        nxt = edges.join(near, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
        frontier = materialize(nxt.withColumn("hop", F.lit(h)))
        seen = seen.unionByName(frontier)
    return seen


def activate(sub: DataFrame, start: DataFrame, edges: DataFrame, sims: DataFrame, c: float = MIN_SIMILARITY, tolerance: float = 1e-6) -> DataFrame:
    """Activation after synchronous rounds: a = min(1, a + sum of a_src * weight) along distinct edges inside the subgraph.

    Rounds go on until no activation moves by more than the tolerance; activations only grow and end at 1, so they end.
    """
    w = F.least(F.lit(1.0), (F.col("cos") - c) / (1 - c))
    live = edges.withColumn("text_key", F.xxhash64("text")).join(sims.filter(F.col("cos") > c), "text_key").select("src", "dst", w.alias("w"))
    live = materialize(live.join(sub.select(F.col("id").alias("dst")), "dst", "left_semi").join(sub.select(F.col("id").alias("src")), "src", "left_semi"))
    act = materialize(sub.join(start.select("id", F.lit(1.0).alias("a")), "id", "left").select("id", F.coalesce("a", F.lit(0.0)).alias("a")))
    while True:
        push = live.join(act.filter("a > 0"), live.src == act.id).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("w") * F.col("a")).alias("g"))
        after = F.least(F.lit(1.0), F.col("a") + F.coalesce("g", F.lit(0.0)))
        moved = materialize(act.join(push, "id", "left").select("id", after.alias("a"), (after - F.col("a")).alias("_move")))
        act = moved.select("id", "a")
        if not moved.filter(F.col("_move") > tolerance).limit(1).count():
            return act


def context(act: DataFrame, edges: DataFrame, threshold: float = MIN_ACTIVATION, relations: int = 20, max_chunks: int = 6) -> DataFrame:
    """First relation texts (sorted) and neighbouring chunks of the activated nodes."""
    near = act.filter(F.col("a") >= threshold).join(edges, act.id == edges.src).select("text", "dst")
    rel = near.select(F.lit("relation").alias("kind"), F.col("text").alias("value")).distinct().orderBy("value").limit(relations)
    doc = near.filter(F.col("dst").startswith("chunk:")).select(F.lit("chunk").alias("kind"), F.col("dst").alias("value")).distinct().orderBy("value").limit(max_chunks)
    return rel.unionByName(doc)
