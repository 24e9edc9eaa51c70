"""Full-text search: boolean matching, BM25 ranking, filters, exclusions and top-k over indexed notes.

There are two indexes with one set of questions. A ``Kept`` index holds a posting for every term of every note: the
term's positions, and the note's length and times, so a search reads the postings of its own words and nothing else.
What ranking needs of the collection is stored when an index is committed: the number of notes and tokens, and for
every term and class of note lengths how many notes have it and how often at most. From those a bound on the score of
any note of a class follows, and a search for the best few reads the classes whose bound reaches the score of the last
of them. For a table that is not indexed, ``index_text`` puts a note's tokens into one string a column, and a boolean
tree is one predicate on the scan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from noteql.functions import extract
from noteql.functions.dates import DateRange, QueryError
from noteql.functions.text import MARKS, folded_tokens, occurrences, stem_of, stems, term_string, tokenize, tokens
from noteql.plans.query import And, Or, ParsedQuery, Term, parse
from noteql.scratch import stored
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
DEFAULT_LIMIT = 10
COLUMNS = ("content_terms", "metadata_terms")
FIELDS = ("content", "metadata")
#: Terms that are no tokens: of notes with marks, or signs of private use, that tokens keep together; and of the metric
#: keys and records that a note mentions, which patterns find whatever stands around them.
IRREGULAR, KEY, REFERENCE = "\0", "\0key:", "\0ref:"
#: Classes of note lengths for every doubling.
CLASSES = 4


def length_class(dl: Column) -> Column:
    return F.floor(F.log2(F.col("dl") + 1.0) * CLASSES).cast("int")


@dataclass
class Statistics:
    """Of the collection and of a search's words: number of notes, mean length, notes by (word, field), and by class of
    lengths the shortest note and the most occurrences by (word, field). The field of both together is None."""

    notes: float
    mean: float
    having: dict = field(default_factory=dict)
    shortest: dict = field(default_factory=dict)
    most: dict = field(default_factory=dict)


@dataclass
class Kept:
    """postings: (term, cls, note_id, dl, file_modified_at, created_at, content, metadata), positions by field. lengths:
    (note_id, dl, file_modified_at, created_at), one row a note, which searches for words do not read. terms and corpus
    as ``summaries`` makes them."""

    postings: DataFrame
    lengths: DataFrame
    terms: DataFrame
    corpus: DataFrame
    stem: bool = False

    def rows(self, words: set[str], every: bool = False, classes: list[int] | None = None) -> DataFrame:
        """Notes that hold one of the words, or every note, with ``hits``: positions by word and field. Of some classes
        of lengths alone, if they are given."""
        found = self.postings.where(F.col("term").isin(sorted(words))) if words else self.postings.limit(0)
        if classes is not None:
            found = found.where(F.col("cls").isin(classes))
        # As many entries a note as there are words.
        hits = F.map_from_entries(F.collect_list(F.struct("term", F.struct(*FIELDS)))).alias("hits")
        notes = [F.first(c).alias(c) for c in ("dl", "file_modified_at", "created_at")]
        if not every:
            return found.groupBy("note_id").agg(*notes, hits)
        return self.lengths.join(found.groupBy("note_id").agg(hits), "note_id", "left")

    def statistics(self, words: set[str]) -> Statistics:
        """One small job: some rows for each word."""
        sums = [F.sum(c).alias(c) for c in ("n", "n_content", "n_metadata")]
        of_words = self.terms.where(F.col("term").isin(sorted(words))).groupBy("term", "cls").agg(*sums, F.max("most_content").alias("most_content"), F.max("most_metadata").alias("most_metadata"), F.min("shortest").alias("shortest"))
        of_all = self.corpus.agg(F.sum("notes").alias("notes"), F.sum("tokens").alias("tokens"))
        rows = of_words.unionByName(of_all, allowMissingColumns=True).collect()
        total = next(r for r in rows if r.term is None)
        out = Statistics(float(total.notes or 0), (total.tokens or 0) / total.notes if total.notes else 0.0)
        for r in rows:
            if r.term is None:
                continue
            for name, n, most in ((None, r.n, r.most_content + r.most_metadata), ("content", r.n_content, r.most_content), ("metadata", r.n_metadata, r.most_metadata)):
                out.having[r.term, name] = out.having.get((r.term, name), 0) + n
                out.most[r.cls, r.term, name] = most
            out.shortest[r.cls] = min(r.shortest, out.shortest.get(r.cls, r.shortest))
        return out


def mentions(said: Column) -> Column:
    """The terms of what a text mentions."""
    return F.concat(F.transform(extract.metric_keys(said), lambda x: F.concat(F.lit(KEY), x)), F.transform(extract.metric_refs(said), lambda x: F.concat(F.lit(REFERENCE), x)))


def build(notes: DataFrame, content: Column, metadata: Column, stem: bool = False, said: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(postings, lengths) of notes (note_id, file_modified_at, created_at); ``said`` is the text whose mentions count. A note's text is shuffled once, whole, and
    its tokens are grouped where it is. Stems are made of the distinct terms, in a table of their own."""
    odd = F.when(F.concat_ws(" ", content, metadata).rlike(MARKS + r"|\p{Co}"), F.array(F.lit(IRREGULAR))).otherwise(F.array().cast("array<string>"))
    placed = notes.repartition("note_id").select("note_id", "file_modified_at", "created_at", F.concat(odd, mentions(F.coalesce(said, F.lit("")) if said is not None else F.lit(""))).alias("odd"), folded_tokens(content).alias("content"), folded_tokens(metadata).alias("metadata"))
    lengths = placed.select("note_id", (F.size("content") + F.size("metadata")).alias("dl"), "file_modified_at", "created_at")
    of_note = ("note_id", "dl", "file_modified_at", "created_at")
    fields = F.explode(F.create_map(F.lit("content"), "content", F.lit("metadata"), "metadata", F.lit("odd"), "odd")).alias("field", "tokens")
    each = placed.withColumn("dl", F.size("content") + F.size("metadata")).select(*of_note, fields).select(*of_note, "field", F.posexplode("tokens").alias("position", "term"))
    at = lambda c: F.sort_array(F.collect_list(F.when(F.col("field") == c, F.col("position")))).alias(c)
    postings = each.groupBy("note_id", "term").agg(*[F.first(c).alias(c) for c in of_note[1:]], *map(at, FIELDS))
    if stem:
        postings = stored(postings)
        known = stored(postings.select("term").distinct().select("term", stem_of("term").alias("stem")))
        one = lambda c: F.sort_array(F.flatten(F.collect_list(c))).alias(c)
        postings = postings.join(known, "term").groupBy("note_id", F.col("stem").alias("term")).agg(*[F.first(c).alias(c) for c in of_note[1:]], *map(one, FIELDS))
    return postings.select("term", length_class(F.col("dl")).alias("cls"), *of_note, *FIELDS), lengths


def summaries(postings: DataFrame, lengths: DataFrame, part: Column) -> tuple[DataFrame, DataFrame]:
    """(terms, corpus) for each part of an index: what is known of the terms of every class of lengths, and how many notes
    and tokens there are. Parts are added up by a search, so a commit makes those anew that it writes."""
    has = lambda c: F.count_if(F.size(c) > 0)
    terms = postings.groupBy(part.alias("part"), "term", "cls").agg(
        F.count(F.lit(1)).alias("n"), has("content").alias("n_content"), has("metadata").alias("n_metadata"),
        F.max(F.size("content")).alias("most_content"), F.max(F.size("metadata")).alias("most_metadata"), F.min("dl").alias("shortest"),
    )
    return terms, lengths.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("notes"), F.sum("dl").alias("tokens"))


def index_text(notes: DataFrame, content: Column, metadata: Column, stem: bool = False) -> DataFrame:
    """``notes`` with content_terms, metadata_terms and dl, the number of tokens of both."""
    made = (lambda c: stems(folded_tokens(c))) if stem else folded_tokens
    out = notes.withColumn("__c", made(content)).withColumn("__m", made(metadata))
    return out.withColumn("content_terms", term_string(F.col("__c"))).withColumn("metadata_terms", term_string(F.col("__m"))).withColumn("dl", F.size("__c") + F.size("__m")).drop("__c", "__m")


def postings(notes: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, term, position) of every token."""
    return notes.select(id_col, F.posexplode(tokens(text)).alias("position", "term"))


def leaves(node) -> list[Term]:
    if node is None:
        return []
    return [node] if isinstance(node, Term) else [t for p in node.parts for t in leaves(p)]


def words_of(nodes: list, stem: bool = False) -> set[str]:
    return {w for node in nodes for t in leaves(node) for w in tokenize(t.text, stem)}


def frequency(term: Term, stem: bool = False, kept: bool = False) -> Column:
    """How often a term or phrase stands in the columns it is scoped to."""
    words = tokenize(term.text, stem)
    if not words:
        return F.lit(0)
    cols = COLUMNS if term.column is None else (f"{term.column}_terms",)
    count = _by_positions if kept else lambda c, w: occurrences(F.col(c), w)
    return reduce(lambda a, b: a + b, [count(c, words) for c in cols])


def _by_positions(column: str, words: list[str]) -> Column:
    """Places where the words of a phrase follow each other, by their positions."""
    at = [F.coalesce(F.try_element_at(F.col("hits"), F.lit(w))[column.removesuffix("_terms")], F.array().cast("array<int>")) for w in words]
    begun = lambda k: F.transform(at[k], lambda x: x - k)
    return F.size(reduce(F.array_intersect, [begun(k) for k in range(1, len(at))], at[0]))


def matches(node, stem: bool = False, kept: bool = False) -> Column:
    """Whether a note matches a boolean tree; no tree matches every note, a term without tokens none."""
    if node is None:
        return F.lit(True)
    if isinstance(node, Term):
        return frequency(node, stem, kept) > 0
    parts = [matches(p, stem, kept) for p in node.parts]
    return reduce(lambda a, b: a & b, parts) if isinstance(node, And) else reduce(lambda a, b: a | b, parts)


def excluded(excludes: list, stem: bool = False, kept: bool = False) -> Column:
    return reduce(lambda a, b: a | b, [matches(x, stem, kept) for x in excludes], F.lit(False))


def rank(indexed: DataFrame | Kept, node, stem: bool = False, excludes: list = (), classes: list[int] | None = None, weights: tuple | None = None) -> DataFrame:
    """Indexed notes that match and are not excluded, with ``rank``: BM25 over all notes, negated, so less is better.
    ``classes`` and ``weights`` are those of a kept index, if they are known."""
    terms = leaves(node)
    kept = isinstance(indexed, Kept)
    idf, mean = weights or _weights(indexed, node, stem)
    tf = _frequencies(indexed.rows(words_of([node, *excludes], stem), classes=classes) if kept else indexed, terms, stem, kept)
    found = tf.where(_by_frequency(node, iter(range(len(terms))))).where(~excluded(list(excludes), stem, kept))
    total = F.lit(0.0)
    for k in range(len(terms)):
        total = total + F.lit(idf[k] * (K1 + 1)) * F.col(f"tf{k}") / (F.col(f"tf{k}") + K1 * (1 - B + B * F.col("dl") / F.lit(mean or 1.0)))
    return found.withColumn("rank", -total).drop(*[f"tf{k}" for k in range(len(terms))])


def _frequencies(rows: DataFrame, terms: list[Term], stem: bool, kept: bool) -> DataFrame:
    return rows.withColumns({f"tf{k}": frequency(t, stem, kept).cast("double") for k, t in enumerate(terms)}) if terms else rows


def _weights(indexed: DataFrame | Kept, node, stem: bool, stats: Statistics | None = None) -> tuple[list[float], float]:
    """The inverse document frequency of every leaf, and the mean length: a few numbers, by way of the driver. A kept index
    has those of single words; notes with a phrase are counted among those with its words."""
    terms = leaves(node)
    kept = isinstance(indexed, Kept)
    counted = [F.count_if(F.col(f"tf{k}") > 0).cast("double").alias(f"n{k}") for k in range(len(terms))]
    if kept:
        stats = stats or indexed.statistics(words_of([node], stem))
        notes, mean = stats.notes, stats.mean
        words = [tokenize(t.text, stem) for t in terms]
        have = [float(stats.having.get((w[0], t.column), 0)) if len(w) == 1 else None for t, w in zip(terms, words)]
        open_ = [k for k, n in enumerate(have) if n is None]
        if open_:
            rows = _frequencies(indexed.rows(words_of([terms[k] for k in open_], stem)), terms, stem, kept)
            more = rows.agg(*[counted[k] for k in open_]).first()
            have = [more[f"n{k}"] or 0.0 if n is None else n for k, n in enumerate(have)]
    else:
        row = _frequencies(indexed, terms, stem, kept).agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("dl").alias("mean"), *counted).first()
        notes, mean, have = row["n"] or 0.0, row["mean"] or 0.0, [row[f"n{k}"] or 0.0 for k in range(len(terms))]
    odds = [(notes - n + 0.5) / (n + 0.5) for n in have]
    return [math.log(x) if x > 1 else 1e-6 for x in odds], mean


def _bounds(node, stem: bool, stats: Statistics, idf: list[float]) -> dict[int, float]:
    """The highest score that a note of each class of lengths may have; classes without a match are left out."""

    def of(node, cls: int, numbers) -> float | None:
        if isinstance(node, Term):
            k = next(numbers)
            words = tokenize(node.text, stem)
            tf = min((stats.most.get((cls, w, node.column), 0) for w in words), default=0)
            return idf[k] * (K1 + 1) * tf / (tf + K1 * (1 - B + B * stats.shortest[cls] / (stats.mean or 1.0))) if tf else None
        parts = [of(p, cls, numbers) for p in node.parts]
        some = [x for x in parts if x is not None]
        return sum(some) if some and (len(some) == len(parts) or not isinstance(node, And)) else None

    found = {cls: of(node, cls, iter(range(len(leaves(node))))) for cls in stats.shortest}
    return {cls: x for cls, x in found.items() if x is not None}


def _best(indexed: Kept, q: ParsedQuery, limit: int, stem: bool, passed) -> DataFrame:
    """Ranked notes among which the best are: first those of the classes with the highest bounds that may have enough, then
    of every class whose bound reaches the worst of those. ``passed`` applies the query's filters."""
    stats = indexed.statistics(words_of([q.expr], stem))
    weights = _weights(indexed, q.expr, stem, stats)
    bounds = _bounds(q.expr, stem, stats, weights[0])
    ranked = lambda classes: passed(rank(indexed, q.expr, stem, q.excludes, classes, weights))
    order = sorted(bounds, key=lambda c: (-bounds[c], c))
    if len(order) <= FIRST_CLASSES:
        return ranked(order)
    # As many rows as the limit.
    worst = [-r["rank"] for r in ranked(order[:FIRST_CLASSES]).orderBy("rank", "note_id").limit(limit).select("rank").collect()]
    least = worst[-1] if len(worst) == limit else -math.inf
    return ranked([c for k, c in enumerate(order) if k < FIRST_CLASSES or bounds[c] >= least - 1e-9])


#: Classes that a search for the best reads before it knows which others it needs.
FIRST_CLASSES = 4


def _by_frequency(node, numbers) -> Column:
    if node is None:
        return F.lit(True)
    if isinstance(node, Term):
        return F.col(f"tf{next(numbers)}") > 0
    parts = [_by_frequency(p, numbers) for p in node.parts]
    return reduce(lambda a, b: a & b if isinstance(node, And) else a | b, parts)


def score(rank_: Column) -> Column:
    """1 - e^-max(-rank, 0); 0 for ranks that are no finite number."""
    bad = rank_.isNull() | F.isnan(rank_) | (F.abs(rank_) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(1 - F.exp(-F.greatest(-rank_, F.lit(0.0))))


def date_filtered(notes: DataFrame, filters: dict[str, DateRange], metadata_dates: DataFrame | None = None) -> DataFrame:
    """Notes within all ranges: modified and created by file times, others by any metadata date of that name."""
    for name, span in filters.items():
        if name == "modified":
            notes = notes.where(span.contains(F.col("file_modified_at")))
        elif name == "created":
            notes = notes.where(span.contains(F.col("created_at")))
        elif metadata_dates is None:
            raise QueryError(f"no metadata dates to filter {name} by")
        else:
            inside = metadata_dates.where((F.lower("key") == name) & span.contains(F.col("value")))
            notes = notes.join(inside.select("note_id"), "note_id", "left_semi")
    return notes


def passing(indexed: DataFrame | Kept, filters: dict[str, DateRange], excludes: list, metadata_dates: DataFrame | None = None, stem: bool = False) -> DataFrame:
    """Notes within the ranges that are not excluded."""
    kept = isinstance(indexed, Kept)
    rows = indexed if not kept else indexed.rows(words_of(excludes, stem), every=True) if excludes else indexed.lengths
    return date_filtered(rows, filters, metadata_dates).where(~excluded(list(excludes), stem, kept))


def search(indexed: DataFrame | Kept, query: str | ParsedQuery, limit: int = DEFAULT_LIMIT, now: datetime | None = None, metadata_dates: DataFrame | None = None, stem: bool = False) -> DataFrame:
    """note_id, rank, score and reason of the best notes, best first. Filters and exclusions come before the limit;
    statistics are those of all notes. A query of filters alone ranks by file time, newest first, with score 0."""
    q = parse(query, now) if isinstance(query, str) else query
    stem = stem or isinstance(indexed, Kept) and indexed.stem
    if limit < 1:
        raise QueryError("a limit is at least 1")
    if q.expr is None:
        found = passing(indexed, q.filters, q.excludes, metadata_dates, stem)
        top = found.orderBy(F.col("file_modified_at").desc_nulls_last(), "note_id").limit(limit)
        return top.select("note_id", F.lit(0.0).alias("rank"), F.lit(0.0).alias("score"), F.lit("Filter match").alias("reason"))
    passed = lambda rows: date_filtered(rows, q.filters, metadata_dates)
    found = _best(indexed, q, limit, stem, passed) if isinstance(indexed, Kept) else passed(rank(indexed, q.expr, stem, q.excludes))
    top = found.orderBy("rank", "note_id").limit(limit)
    return top.select("note_id", "rank", score(F.col("rank")).alias("score"), F.lit("Full-text match").alias("reason"))


def matching_ids(indexed: DataFrame | Kept, query: str, now: datetime | None = None, stem: bool = False) -> DataFrame:
    """Every matching id, without a limit."""
    q = parse(query, now)
    kept = isinstance(indexed, Kept)
    stem = stem or kept and indexed.stem
    rows = indexed.rows(words_of([q.expr, *q.excludes], stem), every=q.expr is None) if kept else indexed
    return rows.where(matches(q.expr, stem, kept) & ~excluded(q.excludes, stem, kept)).select("note_id")


def within(notes: DataFrame, ids: DataFrame, filters: dict[str, DateRange], metadata_dates: DataFrame | None = None) -> DataFrame:
    """Distinct notes of a set of ids that pass the filters."""
    return date_filtered(notes.join(ids.select("note_id").distinct(), "note_id", "left_semi"), filters, metadata_dates)


def enrich(results: DataFrame, notes: DataFrame, terms: str = "") -> DataFrame:
    """Results with title, path, metadata and a snippet of the content."""
    looked = results.join(notes.select("note_id", "title", "relative_path", "metadata", "content"), "note_id", "left")
    return looked.withColumn("preview", extract.snippet(F.coalesce("content", F.lit("")), F.lit(terms))).drop("content")


__all__ = ["And", "Or", "Term", "index_text", "search"]
