"""A project run: files, documents, sections, turns, tokens and the features asked for, as one lazy plan.

Nothing is read back from disk between the steps; what several features share is cached once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Config, ConfigError, Topics
from ..functions import providers, subwords
from ..functions import text as T
from ..functions import vectors as V
from ..operators import aggregate, lm, randomness, segment, similarity, topics
from ..session import prepare
from ..sources import entities, readers, sinks

UTT = "utt_key"


@dataclass
class Run:
    """The tables of a run by name, in the order in which they were made."""

    config: Config
    tables: dict[str, DataFrame] = field(default_factory=dict)


def documents(spark: SparkSession, root: str, config: Config) -> DataFrame:
    """Documents of a project tree with their corpus; files that can't be read keep their error."""
    prepare(spark)
    files = entities.scan(spark, root, config.task_name)
    if config.corpus_key and config.corpus_values:
        files = entities.corpus_filter(files, config.corpus_key, config.corpus_values)
    else:
        files = files.withColumn("corpus", F.lit(None).cast("string"))
    docs = entities.typed(readers.read_text(files))
    return docs.withColumn("doc_id", F.xxhash64("path"))


def sections(docs: DataFrame, config: Config) -> DataFrame:
    """doc_id, section_idx, title, content, cleaned."""
    s = config.sections
    if s.identifier:
        found = segment.titled_sections(docs, s.identifier)
        if s.number is not None:
            bad = segment.section_problems(found, docs, s.number).select("doc_id").distinct()
            found = found.join(bad, "doc_id", "left_anti")
    else:
        found = segment.untitled_sections(docs, s.has_titles).withColumn("section_idx", F.lit(0))
    found = found.withColumn("cleaned", F.col("content"))
    options = config.pipeline_options if config.pipeline_options is not None else {"clean_text": True}
    for name, on in options.items():  # in the order of the configuration
        if on:
            found = STEPS[name](found, config)
    return found


#: name -> function of sections (content, cleaned, and what earlier steps made) and the configuration; a project's own are registered by name.
STEPS: dict[str, Callable[[DataFrame, Config], DataFrame]] = {}


def step(name: str):
    """Register a preprocessing step under the name that a configuration has for it."""

    def put(f):
        STEPS[name] = f
        return f

    return put


@step("quality_check")
def _quality_check(found: DataFrame, config: Config) -> DataFrame:
    return found


@step("clean_text")
def _clean_text(found: DataFrame, config: Config) -> DataFrame:
    c, f = config.cleaning, config.fluency
    if f:
        return found.withColumn("cleaned", T.fluency_clean(T.fluency_words("content", f.word_splitter), f.remove_hyphens, f.remove_duplicates, f.lowercase))
    return found.withColumn("cleaned", T.clean("content", c.timestamp, c.characters, c.brackets, c.punctuation, c.lowercase, c.tidy))


@step("tokenize_text")
def _tokenize_text(found: DataFrame, config: Config) -> DataFrame:
    """tokens: of the text as it stands, so before cleaning they are those of the raw one."""
    return found.withColumn("tokens", T.words("cleaned"))


@step("normalize_text")
def _normalize_text(found: DataFrame, config: Config) -> DataFrame:
    """normal_forms of the tokens; without tokens there is nothing to normalise."""
    if "tokens" not in found.columns:
        raise ConfigError("normalize_text needs tokenize_text before it")
    normal = providers.get("normalizer", config.normalizer)
    return found.withColumn("normal_forms", F.transform("tokens", normal))


def turns(found: DataFrame, config: Config) -> DataFrame:
    """doc_id, section_idx, utt_idx, utt_key, content: the texts of the speakers asked for."""
    keyed = found.select("doc_id", "section_idx", F.concat_ws("/", F.col("doc_id").cast("string"), F.col("section_idx").cast("string")).alias("part"), F.col("cleaned").alias("text"))
    made = segment.speaker_filter(keyed, config.speaker_tags, config.keep_speakertags, key="part")
    made = made.join(keyed.select("part", "doc_id", "section_idx"), "part")
    return made.select("doc_id", "section_idx", "utt_idx", F.concat_ws("/", "part", F.col("utt_idx").cast("string")).alias(UTT), "content")


def tokens(spoken: DataFrame, config: Config) -> DataFrame:
    """doc_id, section_idx, utt_idx, utt_key, pos, token: whitespace tokens of turns."""
    own = T.words("content")
    e = config.embeddings
    if e.lowercase:
        own = F.transform(own, F.lower)
    if e.remove_punctuation:
        own = F.transform(own, T.remove_punctuation)
    return spoken.select("doc_id", "section_idx", "utt_idx", UTT, F.posexplode(own).alias("pos", "token"))


def embed(toks: DataFrame, config: Config) -> DataFrame:
    """Tokens with vectors, without zero ones; places are numbered anew."""
    e = config.embeddings
    t = toks.filter(~T.is_punctuation_token("token")) if e.exclude_punctuation_tokens else toks
    if e.tokenization_method == "whitespace":
        t = t.withColumn("vec", providers.get("embedder", e.provider)(F.col("token"), e.dimensions))
    else:
        t = _subword_vectors(t, config)
    t = t.withColumn("norm", V.norm(F.col("vec")))
    t = similarity.drop_zero_vectors(t)
    return t.withColumn("pos", F.row_number().over(Window.partitionBy(UTT).orderBy("pos")) - 1)


def _subword_vectors(toks: DataFrame, config: Config) -> DataFrame:
    """Subword tokens with their vectors in the context of their turn; only the method `model` keeps special tokens as they are."""
    e = config.embeddings
    ids = ["doc_id", "section_idx", "utt_idx", UTT]
    turn = F.sort_array(F.collect_list(F.struct("pos", "token")))
    texts = toks.groupBy(*ids).agg(turn.alias("turn")).select(*ids, F.array_join(F.transform("turn", lambda r: r["token"]), " ").alias("text"))
    made = subwords.embed(subwords.encode(texts, e.tokenizer, UTT, max_length=e.max_length), e.provider, UTT)
    if e.tokenization_method == "model_roberta":
        made = T.clean_tokens(made.filter(~T.is_punctuation_token("token")), model=True)
    return texts.select(*ids).join(made, UTT)


def run(spark: SparkSession, root: str, config: Config) -> Run:
    """All tables of a project, none of them written yet."""
    out = Run(config)
    t = out.tables
    t["documents"] = documents(spark, root, config)
    good = t["documents"].filter("error IS NULL")
    t["sections"] = sections(good, config)
    t["turns"] = turns(t["sections"], config)
    t["tokens"] = tokens(t["turns"], config)
    for metric in config.metrics_to_extract:
        METRICS[metric](out)
    if config.create_aggregation_of_results and "similarity_summary" in t:
        people = t["documents"].select("doc_id", F.col("participant_id").alias("participant"), "corpus")
        scores = t["similarity_summary"].join(people, "doc_id")
        t["participant_aggregation"] = aggregate.participant_scores(scores.withColumn("participant", F.concat_ws("@", "participant", "corpus")), "participant", "window")
    if config.document_information:
        counts = aggregate.last_section_word_count(t["tokens"].groupBy("doc_id", "section_idx").agg(F.collect_list("token").alias("tokens")))
        f = config.fluency
        info = good.join(counts, "doc_id", "left")
        if f:
            w = T.fluency_words("text", f.word_splitter)
            info = info.withColumn("fluency_duplicate_count", T.repeats(w)).withColumn("number_of_duplicates", T.repeats(T.fluency_split("text", f.word_splitter)))
        t["document_information"] = aggregate.document_information(info, ["participant_id", "session", "task", "corpus", *config.document_information])
    return out


def _embeddings(r: Run) -> None:
    t, e = r.tables, r.config.embeddings
    vectors = t["token_vectors"] = embed(t["tokens"], r.config).cache()
    keys = vectors.select(UTT, "doc_id", "section_idx", "utt_idx").distinct()
    made = []
    for size in e.window_sizes:
        if size == "all":
            s = similarity.window_all(vectors, UTT)
            none = F.lit(None).cast("double")
            s = s.select(UTT, F.col("mean").alias(similarity.METRICS[0]), none.alias(similarity.METRICS[1]), F.col("std").alias(similarity.METRICS[2]), none.alias(similarity.METRICS[3]), F.col("median").alias(similarity.METRICS[4]))
        else:
            s = similarity.window_summary(vectors, UTT, int(size))
            if e.window_details:
                t[f"window_details_{size}"] = similarity.window_details(vectors, UTT, int(size))
        made.append(similarity.long_metrics(s, UTT, None).withColumn("window", F.lit(f"window-{size}")))
    if e.sentences:
        # By end marks; a turn whose tokens have none by the sentences of its text.
        marked = segment.sentence_blocks(vectors, t["turns"].select(UTT, F.col("content").alias("text")), UTT)
        sents = similarity.sentence_vectors(marked, UTT)
        t["sentence_details"] = similarity.sentence_details(sents, UTT)
        made.append(similarity.long_metrics(similarity.sentence_summary(sents, UTT), UTT, None).withColumn("window", F.lit("sentence")))
    if made:
        summary = made[0]
        for m in made[1:]:
            summary = summary.unionByName(m)
        t["similarity_summary"] = summary.join(keys, UTT)
    x = r.config.randomness
    if x and x.use_tsp_divergence:
        t["divergence"] = randomness.divergence(vectors, UTT, x.max_tsp_tokens, x.n_permute or x.bootstrap, x.random_seed)
    elif x:
        t["randomness"] = randomness.windows(randomness.first_places(vectors, UTT), UTT, x.window_size, x.bootstrap, x.shuffle_mode)


def _logits(r: Run) -> None:
    x = r.config.logits
    scored = lm.bigram_scores(r.tables["tokens"], [UTT], x.alpha)
    r.tables["token_logits"] = segment.context_chunks(scored, x.chunk_size, x.overlap_size)


def _perplexity(r: Run) -> None:
    p, scored = r.config.perplexity, r.tables["token_logits"]
    rows = scored.groupBy(UTT).agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("rows"))
    bare = F.transform("rows", lambda x: x["token"])
    kept = F.size(lm.trim_artifacts(bare, r.config.logits.trailing_artifact_token_sequences))
    ends = rows.select(UTT, lm.prompt_length(bare, p.ignore_sequences).alias("prompt"), kept.alias("kept"))
    scored = scored.join(ends, UTT).filter("pos <= kept")
    if p.calculate_section_perplexity:
        r.tables["perplexity_section"] = lm.section_perplexity(scored.filter("pos > prompt"), [UTT])
    if p.calculate_sentence_perplexity:
        r.tables["perplexity_sentence"] = lm.sentence_perplexity(scored, UTT, F.col("prompt"))


def _in_chunks(vectors: DataFrame, spoken: DataFrame, x: Topics) -> DataFrame:
    """Vectors of turns with the unit they belong to: chunks of tokens, or sentences with their share of the tokens; tokens beyond the last share go."""
    n = vectors.groupBy(UTT).agg(F.count(F.lit(1)).alias("n"))
    docs = spoken.select(F.col(UTT).alias("doc_id"), F.col("content").alias("text")).join(n.withColumnRenamed(UTT, "doc_id"), "doc_id")
    if x.chunk_text_units == "sentence":
        chunks = segment.topic_chunks_by_sentence(docs, F.col("n"))
    else:
        chunks = segment.topic_chunks_fixed(docs, F.col("n"), x.chunk_size if x.chunk_text_units == "fixed" else int(x.chunk_text_units))
    last = F.col("first_token") + F.col("n_tokens") - 1
    places = chunks.select(F.col("doc_id").alias(UTT), F.concat_ws("#", "doc_id", F.col("chunk").cast("string")).alias("unit"), F.explode(F.sequence("first_token", last)).alias("pos"))
    return vectors.join(places, [UTT, "pos"])


def _topics(r: Run) -> None:
    t, x = r.tables, r.config.topics
    vectors = t.get("token_vectors")
    if vectors is None:
        vectors = t["token_vectors"] = embed(t["tokens"], r.config).cache()
    unit = UTT if not x.chunk_text_units else "unit"
    v = vectors if unit == UTT else _in_chunks(vectors, t["turns"], x)
    pooled = similarity.pooled(v, unit).withColumnRenamed(unit, "unit_id")
    fitted = topics.fit_topics(pooled, x.nr_topics, x.min_topic_size)
    t["topic_assignments"] = fitted.select("unit_id", "topic_id")
    t["topic_info"] = topics.topic_info(fitted)
    words = v.select(F.col(unit).alias("unit_id"), "token", "doc_id").join(t["topic_assignments"], "unit_id")
    t["topic_keywords"] = topics.keywords(words)
    docs = words.select("unit_id", "doc_id", "topic_id").distinct().withColumn("probability", F.lit(1.0))
    t["document_topic_distribution"] = topics.document_distribution(docs, "doc_id")
    if x.predefined_topics:
        spark = fitted.sparkSession
        given = spark.createDataFrame([(p,) for p in x.predefined_topics], "predefined_topic string").withColumn("token", F.explode(T.words("predefined_topic")))
        given = given.withColumn("vec", providers.get("embedder", r.config.embeddings.provider)(F.col("token"), r.config.embeddings.dimensions))
        mine = topics.as_vectors(topics.centroids(fitted), "topic_id")
        t["topic_comparisons"] = topics.compare(mine, similarity.pooled(given, "predefined_topic"))


METRICS = {"embeddings": _embeddings, "logits": _logits, "perplexity": _perplexity, "topic_modeling": _topics}


def write(r: Run, derivatives: str, form: str = "parquet") -> list[str]:
    """Write every feature table of a run, by participant where its rows know their document; the intermediate ones stay unwritten."""
    skip = {"documents", "sections", "turns", "tokens"}
    names = [n for n in r.tables if n not in skip]
    people = r.tables["documents"].select("doc_id", F.col("participant_id").alias("part"))
    for n in names:
        df = r.tables[n]
        if UTT in df.columns and "doc_id" not in df.columns:
            df = df.withColumn("doc_id", F.split_part(UTT, F.lit("/"), F.lit(1)).cast("long"))
        if "doc_id" in df.columns and "part" not in df.columns:
            df = df.join(people, "doc_id")
        sinks.write_features(df, derivatives, n, r.config.output_policy, form)
    return names
