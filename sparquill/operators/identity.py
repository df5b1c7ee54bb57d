"""Exact identity: lookups by several keys, exact matches, uniqueness, coverage, ingest decisions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparquill.functions import text as X
from sparquill.session import stored

# The order in which a name is tried.
LOOKUP_ORDER = ("id", "dir_name", "doi", "pmid", "publication_number")


def lookup(asked: DataFrame, registry: DataFrame, keys: tuple[str, ...] = LOOKUP_ORDER, prefix: bool = False) -> DataFrame:
    """asked (name) to one registry row each: the first key in order that holds the name.

    Each key is one equi-join; the candidates meet in a window per name, a handful of
    rows each. With prefix, directory names that start with the name come last,
    those not marked as duplicates first, then the shortest, then by name.
    """
    found = []
    for i, key in enumerate(keys):
        value = {"doi": X.normalize_doi("name"), "pmid": X.normalize_pmid("name")}.get(key, F.trim("name"))
        wanted = asked.select("name", value.alias("__value")).where("__value <> ''")
        here = registry.withColumn("__value", F.lower(key) if key == "doi" else F.col(key).cast("string"))
        found.append(wanted.join(here, "__value").drop("__value").withColumns({"matched_by": F.lit(key), "__order": F.lit(i)}))
    if prefix:
        # a prefix meets names in the same bucket of its first two characters
        wanted = asked.select("name", F.substring("name", 1, 2).alias("__b")).where(F.length("name") >= 2)
        here = registry.withColumn("__b", F.substring("dir_name", 1, 2))
        found.append(wanted.join(here, "__b").where(F.col("dir_name").startswith(F.col("name"))).drop("__b").withColumns({"matched_by": F.lit("prefix"), "__order": F.lit(len(keys))}))
    every = reduce(lambda a, b: a.unionByName(b), found)
    best = Window.partitionBy("name").orderBy("__order", F.col("dir_name").startswith("DUP-"), F.length("dir_name"), "dir_name", "id")
    return every.withColumn("__rn", F.row_number().over(best)).where("__rn = 1").drop("__rn", "__order")


def exact_matches(asked: DataFrame, registry: DataFrame) -> DataFrame:
    """asked (name) to all registry rows that a normalised doi, pmid or title equals; the first field that matches names the row."""
    found = []
    for i, (field, norm) in enumerate((("doi", X.normalize_doi), ("pmid", X.normalize_pmid), ("title", X.normalize_title))):
        wanted = asked.select("name", norm("name").alias("__value")).where("__value <> ''")
        here = registry.withColumn("__value", norm(field)).where("__value <> ''")
        found.append(wanted.join(here, "__value").drop("__value").withColumns({"matched_by": F.lit(field), "__order": F.lit(i)}))
    every = reduce(lambda a, b: a.unionByName(b), found)
    first = Window.partitionBy("name", "id").orderBy("__order")
    return every.withColumn("__rn", F.row_number().over(first)).where("__rn = 1").drop("__rn", "__order")


def match_summary(asked: DataFrame, matches: DataFrame) -> DataFrame:
    """Per name: match_count, found, ambiguous."""
    n = matches.groupBy("name").agg(F.count("*").alias("n"))
    counted = asked.select("name").distinct().join(n, "name", "left").withColumn("match_count", F.coalesce("n", F.lit(0)).cast("long"))
    return counted.select("name", "match_count", (F.col("match_count") > 0).alias("found"), (F.col("match_count") > 1).alias("ambiguous"))


def coverage(asked: DataFrame, known: DataFrame, key: str = "identifier") -> DataFrame:
    """One row: distinct identifiers asked for, found and missing."""
    d = asked.select(F.trim(key).alias("k")).where("k <> ''").distinct()
    k = known.select(F.trim(key).alias("k"), F.lit(1).alias("hit")).distinct()
    return d.join(k, "k", "left").agg(F.count("*").alias("n_asked"), F.count("hit").alias("n_found"), (F.count("*") - F.count("hit")).alias("n_missing"))


def harvest_identifiers(texts: DataFrame, column: str = "text") -> DataFrame:
    """Per row the distinct identifiers in free text, in order: numbers of 5 to 9 digits, then DOIs."""
    t = X.text_or_empty(column)
    numbers = F.regexp_extract_all(t, F.lit("\\b\\d{5,9}\\b"), F.lit(0))
    dois = F.transform(F.regexp_extract_all(t, F.lit("10\\.\\d{4,9}/[^\\s\"<>]+"), F.lit(0)), lambda d: F.regexp_replace(d, "[.,;)\\]]+$", ""))
    return texts.withColumn("identifiers", F.array_distinct(F.concat(numbers, dois)))


def unique_identifiers(records: DataFrame, keys: tuple[str, ...] = ("pmid", "publication_number"), order: tuple[str, ...] = ("id",)) -> DataFrame:
    """Registry uniqueness: of rows that share a non-empty key the first keeps it, the others get ''.

    Rows without the key, which may be most, are dealt by what orders them instead.
    """
    for key in keys:
        empty = (F.col(key) == "") | F.col(key).isNull()
        w = Window.partitionBy(key, F.when(empty, F.xxhash64(*order))).orderBy(*order)
        records = records.withColumn(key, F.when(empty, "").when(F.row_number().over(w) == 1, F.col(key)).otherwise(""))
    return records


def _grants(events: DataFrame) -> DataFrame:
    """Replay each key's events in order: (kind, value, seq, of, granted) of those that want it.

    events: (kind, value, seq, of, wants, done), `of` the row's id as text. A key is granted
    if nobody or the same id holds it; a row that is done takes it, and a row that is done
    and doesn't want it any more gives it up. Keys are dealt and sorted; a task keeps one holder
    at a time, however many events a key has.
    """
    names = ["kind", "value", "seq", "of", "wants", "done"]

    def replay(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, holder = None, None
        for part in parts:
            rows: list[tuple] = []
            for kind, value, seq, of, wants, done in part[names].itertuples(index=False, name=None):
                if (kind, value) != now:
                    now, holder = (kind, value), None
                if wants:
                    granted = holder is None or holder == of
                    rows.append((kind, value, seq, of, granted))
                    if granted and done:
                        holder = of
                elif holder == of:
                    holder = None
            yield pd.DataFrame(rows, columns=["kind", "value", "seq", "of", "granted"])

    dealt = events.select(*names).repartition("kind", "value").sortWithinPartitions("kind", "value", "seq", "of")
    return dealt.mapInPandas(replay, "kind string, value string, seq long, of string, granted boolean")


def _key(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _events(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """What rows (of, seq, done, keys) want, and what a done row gives up of its id's done row before; of keys that two ids or more want."""
    before = Window.partitionBy("of").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    found = []
    for key in keys:
        had = rows.select("of", "seq", "done", _key(key).alias("value"), F.last(F.when(F.col("done"), _key(key)), ignorenulls=True).over(before).alias("had"))
        found.append(had.where("value <> ''").select(F.lit(key).alias("kind"), "value", "seq", "of", F.lit(True).alias("wants"), "done"))
        found.append(had.where("done and had <> '' and had <> value").select(F.lit(key).alias("kind"), F.col("had").alias("value"), "seq", "of", F.lit(False).alias("wants"), "done"))
    every = reduce(lambda a, b: a.unionByName(b), found)
    contested = every.groupBy("kind", "value").agg(F.min("of").alias("low"), F.max("of").alias("high")).where("low <> high")
    return every.join(contested, ["kind", "value"], "left_semi")


def _skipped(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(of, seq) of rows that meet a key another id holds.

    Whether a row is done depends on earlier rows only. So all keys are replayed at once from
    the last round's outcome, until nothing changes: each round settles the next link of any chain.
    """
    none = stored(rows.where("not done").select("of", "seq"), "upsert-skipped")
    if not keys:
        return none
    touched = stored(rows.join(_events(rows, keys).select("of").distinct(), "of", "left_semi"), "upsert-touched")
    while True:
        now = touched.drop("done").join(none.withColumn("done", F.lit(False)), ["of", "seq"], "left").withColumn("done", F.col("done").isNull())
        refused = _grants(_events(now, keys)).where("not granted").select("of", "seq")
        then = stored(refused.unionByName(rows.where("not done").select("of", "seq")).distinct(), "upsert-skipped")
        if then.exceptAll(none).isEmpty() and none.exceptAll(then).isEmpty():
            return then
        none = then


def upsert_registry(registry: DataFrame, incoming: DataFrame, pos: str = "pos", keys: tuple[str, ...] = ("pmid", "publication_number"), hard: tuple[str, ...] = ("dir_name", "doi")) -> DataFrame:
    """The registry after incoming rows (its columns and their place) are upserted by id, one by one in order.

    A row whose key in `keys` another id holds at that moment is stored without that key; one
    whose key in `hard` another id holds is skipped, as is one without dir_name. A stored row
    gives up what its id held before. Rows of the registry come first; ties of place go by id;
    of rows with the same id and place one counts. Keys the registry lacks are passed over;
    null and empty are no key, null ids are dropped. incoming has no null place.
    """
    keys, hard = (tuple(k for k in names if k in registry.columns) for names in (keys, hard))
    every = registry.withColumn("seq", F.lit(-(1 << 63)).cast("long")).unionByName(incoming.withColumn("seq", F.col(pos).cast("long")).drop(*({pos} - set(registry.columns))))
    every = every.where("id is not null").withColumn("of", F.col("id").cast("string"))
    rows = stored(first_by(every, ["of", "seq"], [F.col(c).cast("string") for c in registry.columns]), "upsert-rows")
    done = F.col("dir_name").isNotNull() if "dir_name" in hard else F.lit(True)
    skipped = _skipped(rows.select("of", "seq", *dict.fromkeys((*hard, *keys)), done.alias("done")), hard)
    rows = rows.join(skipped.withColumn("done", F.lit(False)), ["of", "seq"], "left").withColumn("done", F.col("done").isNull())
    last = first_by(rows.where("done"), ["of"], [F.desc("seq")])
    granted = _grants(_events(rows, keys)) if keys else None
    for key in keys:
        no = granted.where((F.col("kind") == key) & ~F.col("granted")).select("seq", "of", F.lit(True).alias("no"))
        last = last.join(no, ["seq", "of"], "left").withColumn(key, F.when(F.col("no").isNull(), F.coalesce(F.col(key), F.lit(""))).otherwise("")).drop("no")
    return last.select(*registry.columns)


def listing(registry: DataFrame) -> DataFrame:
    """The registry as it is listed: newest first, then by directory name."""
    return registry.orderBy(F.desc_nulls_last("year"), "dir_name")


def last_of(rows: DataFrame, key: str, line: str) -> DataFrame:
    """Per key the row that comes last, as a map read line by line keeps it."""
    return first_by(rows, [key], [F.desc(line)])


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


#: What identifies a record, in the order in which a duplicate's owner is named.
IDENTIFIERS = ("doi", "pmid", "publication_number")
DOCUMENT_TYPES = ("thesis", "book", "document", "patent", "technical-report")


def identifiers(rows: DataFrame, *keep: str) -> DataFrame:
    """(kind, value, keep...): a row for each identifier that rows (doi, pmid, publication_number) have, normalised."""
    forms = {"doi": X.normalize_doi("doi"), "pmid": X.normalize_pmid("pmid"), "publication_number": F.upper(F.trim(X.text_or_empty("publication_number")))}
    each = F.array(*[F.struct(F.lit(k).alias("kind"), forms[k].alias("value")) for k in IDENTIFIERS])
    return rows.select(*keep, F.explode(F.filter(each, lambda x: x["value"] != "")).alias("__x")).select("__x.kind", "__x.value", *keep)


def ingest_decision(incoming: DataFrame, existing: DataFrame, document_types: tuple[str, ...] = DOCUMENT_TYPES) -> DataFrame:
    """Status of each incoming record (pos, doi, pmid, publication_number, title, paper_type), as if they came one by one in order of pos.

    A record whose identifier the library (existing: id and identifiers) or an earlier ingested
    record has is a duplicate of it; one without title is pending; one without identifier is
    pending unless its type needs none; the rest are ingested. Only ingested records hold their
    identifiers. Records of the same place and content count as one; those of the same place go
    by a digest of their content, those without place meet the library alone.
    """
    return ingest_among(incoming, identifiers(existing, "id").withColumn("earlier", F.lit(False)), document_types)


def ingest_among(incoming: DataFrame, owners: DataFrame, document_types: tuple[str, ...] = DOCUMENT_TYPES) -> DataFrame:
    """ingest_decision against owners (kind, value, id, earlier) of identifiers; `earlier` ones are ingested records of the same run.

    An earlier record is held by its identifiers alone: it gives the issue in_batch and no owner.
    Keys are settled in parallel: of each, the first record that is still thought to be ingested
    counts, again until nothing changes. Each round settles the next link of any chain.
    """
    titled = X.normalize_title("title") != ""
    rows = incoming.withColumn("__row", F.xxhash64(*[F.col(c).cast("string") for c in (*IDENTIFIERS, "title", "paper_type")]))
    claims = identifiers(rows.select("pos", "__row", *IDENTIFIERS, titled.alias("takes")), "pos", "__row", "takes")
    met = F.array_position(F.array(*[F.lit(k) for k in IDENTIFIERS]), F.col("kind"))
    owned = owners.groupBy("kind", "value").agg(F.min(F.when(~F.col("earlier"), F.col("id").cast("string"))).alias("id"))
    known = claims.join(owned, ["kind", "value"]).groupBy("pos", "__row").agg(F.min(F.when(F.col("id").isNotNull(), F.struct(met.alias("at"), "id")))["id"].alias("__of"), F.lit(True).alias("__known"))
    known = stored(known, "ingest-known")
    again = stored(_taken(claims.where("pos is not null").join(known, ["pos", "__row"], "left_anti")), "ingest-again")
    here = known.withColumnsRenamed({"pos": "__at", "__row": "__its"})
    out = rows.join(here, (F.col("__row") == F.col("__its")) & F.col("pos").eqNullSafe(F.col("__at")), "left").join(again.withColumn("__again", F.lit(True)), ["pos", "__row"], "left")
    named = reduce(lambda a, b: a | b, [f != "" for f in (X.normalize_doi("doi"), X.normalize_pmid("pmid"), F.trim(X.text_or_empty("publication_number")))])
    twice = F.col("__known").isNotNull() | F.col("__again").isNotNull()
    status = F.when(twice, "duplicate").when(~titled, "pending").when(named | F.coalesce(F.col("paper_type").isin(*document_types), F.lit(False)), "ingested").otherwise("pending")
    issue = F.when(F.col("__of").isNotNull(), "in_library").when(twice, "in_batch").when(~titled, "no_title").when(status == "pending", "no_identifier")
    return out.select(*incoming.columns, status.alias("status"), issue.alias("issue"), F.col("__of").alias("duplicate_of"))


def _taken(claims: DataFrame) -> DataFrame:
    """(pos, __row) of claims (kind, value, pos, __row, takes) to a key that an earlier record took, which no key stopped."""
    place = F.struct("pos", "__row")
    shared = claims.groupBy("kind", "value").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low <> high").select("kind", "value")
    told = stored(claims.join(shared, ["kind", "value"], "left_semi"), "ingest-shared")
    none = told.select("pos", "__row").limit(0)
    while True:
        first = told.where("takes").join(none, ["pos", "__row"], "left_anti").groupBy("kind", "value").agg(F.min(place).alias("first"))
        then = stored(told.join(first, ["kind", "value"]).where(place > F.col("first")).select("pos", "__row").distinct(), "ingest-taken")
        if then.exceptAll(none).isEmpty() and none.exceptAll(then).isEmpty():
            return then
        none = then
