"""Selection, checks and summaries over curated records, entries and layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourcewise.functions.expressions import class_of, clean_double, doi_text, flipped, p_value, p_value_reason, reference_kind


def single_target(records: DataFrame, target: str = "target", wanted: str | None = None) -> str:
    """The target asked for, or the only one that the records name; several or none are an error."""
    if wanted:
        return wanted.strip().upper()
    found = [r[0] for r in records.select(F.upper(F.trim(F.col(target))).alias("t")).where("t <> ''").distinct().orderBy("t").limit(3).collect()]
    if len(found) != 1:
        raise ValueError(f"one target is needed, found {', '.join(found) or 'none'}")
    return found[0]


def table_class(label: Column | None, existing: Column | None, value: Column | None, lower: float, upper: float) -> Column:
    """Class of a row: its label, else an existing class, else that of its value, else unlabelled."""
    text = lambda c: F.when(F.trim(c) != "", F.lower(F.trim(c)))
    parts = [text(c) for c in (label, existing) if c is not None] + ([class_of(value, lower, upper)] if value is not None else [])
    return F.coalesce(*parts, F.lit("unlabelled"))


def prepare_table(table: DataFrame, duplicates: str = "error") -> DataFrame:
    """Rows (id, structure, raw, unit) with their p value and what is wrong with them; repeated structures are an error,
    reduced to the first row (by ``position``), or kept."""
    if duplicates not in ("error", "first", "keep"):
        raise ValueError("duplicates is error, first or keep")
    raw = clean_double(F.col("raw"))
    out = table.withColumn("p_value", p_value(raw, F.col("unit")))
    problem = F.coalesce(p_value_reason(raw, F.col("unit")), F.when(F.col("structure").isNull() | (F.trim("structure") == ""), "missing_structure"))
    out = out.withColumn("problem", problem)
    good = out.where("problem is null").withColumn("copy", F.row_number().over(Window.partitionBy("structure").orderBy("position")))
    if duplicates == "error":
        alone = F.assert_true(F.col("copy") == 1, "a structure stands in several rows").isNull()
        good = good.where(alone)
    elif duplicates == "first":
        good = good.where("copy = 1")
    return good.drop("copy").unionByName(out.where("problem is not null"))


def pick_entry(entries: DataFrame, wanted: str | None = None, row: int | None = None, col: int | None = None) -> DataFrame:
    """The one entry with an id (among ids joined by a semicolon; archive ids in any case) or at a cell; other counts are an error."""
    if wanted is not None:
        wanted = wanted.strip()
        any_case = F.lit(bool(wanted.upper().startswith("CHEMBL") and wanted[6:].isdigit()))
        ids = F.transform(F.split(F.col("ids").cast("string"), ";"), lambda x: F.trim(x))
        hit = F.exists(ids, lambda x: F.when(any_case & x.rlike(r"(?i)^CHEMBL\d+$"), F.upper(x) == wanted.upper()).otherwise(x == wanted))
    else:
        hit = (F.col("row") == row) & (F.col("col") == col)
    found = entries.where(hit)
    n = found.limit(2).count()
    if n != 1:
        raise ValueError("no entry fits" if n == 0 else "several entries fit")
    return found


def resolved(checks: DataFrame) -> DataFrame:
    """Where a checked row leads: itself, a reference row, or the first row of its structure."""
    return checks.select(
        "query_id",
        F.when(F.col("status") == "mapped", F.col("query_id")).when(F.col("status") == "in_reference", F.col("reference_id")).when(F.col("status") == "duplicate_query", F.col("duplicate_of")).alias("shown_id"),
        "status",
    )


def curation_report(flagged: DataFrame, lower: float, upper: float) -> DataFrame:
    """One row of counters over flagged records: records, retained, excluded, entries, repeated, crossing and wide entries, documents."""
    kept = F.size("reasons") == 0
    totals = flagged.agg(
        F.count(F.lit(1)).alias("n_records"), F.count_if(kept).alias("n_retained"), F.count_if(~kept).alias("n_excluded"),
        F.countDistinct(F.when(kept, F.col("document"))).alias("n_documents"),
    )
    entry = flagged.where(kept).groupBy("entry").agg(F.count("value").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    crossing = class_of(F.col("lo"), lower, upper) != class_of(F.col("hi"), lower, upper)
    per = entry.agg(F.count(F.lit(1)).alias("n_entries"), F.count_if(F.col("n") > 1).alias("n_repeated"), F.count_if(crossing).alias("n_crossing"), F.count_if(F.col("hi") - F.col("lo") > 1).alias("n_wide"))
    return totals.join(F.broadcast(per))


def layout_metrics(cells: DataFrame, side: int) -> DataFrame:
    """One row: points, cells, occupancy, extent, and the mean, median and 95 % quantile of the distance to the wished place."""
    d = F.sqrt(F.pow(F.col("row") - F.col("wish_row"), 2) + F.pow(F.col("col") - F.col("wish_col"), 2))
    return cells.agg(
        F.count(F.lit(1)).alias("n_points"), F.lit(side * side).cast("bigint").alias("n_cells"), (F.count(F.lit(1)) / (side * side)).alias("occupancy"),
        (F.max("row") - F.min("row") + 1).alias("height"), (F.max("col") - F.min("col") + 1).alias("width"),
        F.avg(d).alias("mean_shift"), F.median(d).alias("median_shift"), F.percentile(d, F.lit(0.95)).alias("shift_95"),
    )


def usable_bounds(excluded: DataFrame) -> DataFrame:
    """Records excluded for their relation alone, with a positive finite value: the bound on the logarithm's scale and its relation there."""
    raw = clean_double(F.col("raw"))
    only = excluded.where((F.col("reasons") == F.array(F.lit("non_exact_relation"))) & F.col("relation").isin("<", "<=", ">", ">=", "~") & (raw > 0))
    return only.select("entry", "document", flipped(F.col("relation")).alias("relation"), (F.lit(9.0) - F.log10(raw)).alias("bound"))


def agreement_by_set(table: DataFrame) -> DataFrame:
    """Per dataset of (dataset, shown, observed): comparisons, agreement, agreement by chance, and their difference."""
    sizes = table.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("shown") == F.col("observed"), 1.0).otherwise(0.0)).alias("agreement"))
    a = table.groupBy("dataset", F.col("shown").alias("class")).agg(F.count(F.lit(1)).alias("x"))
    b = table.groupBy("dataset", F.col("observed").alias("class")).agg(F.count(F.lit(1)).alias("y"))
    chance = a.join(b, ["dataset", "class"]).groupBy("dataset").agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    out = sizes.join(chance, "dataset", "left").withColumn("chance", F.coalesce("xy", F.lit(0)) / (F.col("n") * F.col("n")))
    return out.select("dataset", "n", "agreement", "chance", (F.col("agreement") - F.col("chance")).alias("difference"))


def top_pairs(offsets: DataFrame, limit: int = 10) -> DataFrame:
    """The pairs to show first: systematic ones, then by the size of the offset, then by document."""
    return offsets.orderBy(F.desc("systematic_offset"), F.desc(F.abs("median_offset")), "document_a", "document_b").limit(limit)


def entry_pairs(offsets: DataFrame, units: DataFrame, entry) -> DataFrame:
    """Offset pairs that involve a document of one entry."""
    own = units.where(F.col("entry") == entry).select(F.explode("documents").alias("d")).distinct()
    ends = offsets.select("document_a", "document_b", F.explode(F.array("document_a", "document_b")).alias("d"))
    hit = ends.join(own, "d", "left_semi").select("document_a", "document_b").distinct()
    return offsets.join(hit, ["document_a", "document_b"])


def group_members(members: DataFrame, limit: int = 12) -> DataFrame:
    """Members of each group (group, id, structure, is_centre) in the order of display, the first ``limit``: centre, structure, id."""
    w = Window.partitionBy("group").orderBy(F.desc("is_centre"), "structure", "id")
    return members.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def joined_summary(members: DataFrame, summary: DataFrame) -> DataFrame:
    """Members with their group's summary; members without a group stay."""
    return members.join(summary, "group", "left")


def feature_ranks(features: DataFrame) -> DataFrame:
    """Features by rows that hold them, then length, then text: (feature, n, place)."""
    counts = features.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    spread = Window.partitionBy("n").orderBy(F.desc(F.length("feature")), "feature")
    more = counts.groupBy("n").agg(F.count(F.lit(1)).alias("k")).withColumn("before", F.coalesce(F.sum("k").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return counts.withColumn("own", F.row_number().over(spread)).join(more.select("n", "before"), "n").select("feature", "n", (F.col("before") + F.col("own")).alias("place"))


def own_measurements(queries: DataFrame, measured: DataFrame, reference: DataFrame) -> DataFrame:
    """Queries with the count and median of their own measurements, and the distance to their reference entry's median."""
    own = measured.groupBy("query_id").agg(F.count("value").alias("n_own"), F.median("value").alias("own_median"))
    return queries.join(own, "query_id", "left").join(reference.select("reference_id", "reference_median"), "reference_id", "left").select(
        "query_id", "reference_id", F.coalesce("n_own", F.lit(0)).alias("n_own"), "own_median", "reference_median", (F.col("own_median") - F.col("reference_median")).alias("difference")
    )


def with_metadata(table: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    """``table`` joined to metadata by key; columns of the same name are taken from the metadata."""
    new = [c for c in metadata.columns if c != key]
    return table.drop(*new).join(metadata, key, "left")


def members_of_sources(records: DataFrame, sources: list) -> DataFrame:
    """Distinct entries of several documents, sorted."""
    return records.where(F.col("document").isin(sources)).select("entry").distinct().orderBy("entry")


def one_key(table: DataFrame, a: str, b: str) -> DataFrame:
    """Values of ``a`` with several of ``b``: what a one-to-one relation must not hold."""
    return table.groupBy(a).agg(F.countDistinct(b).alias("n")).where("n > 1")


def reference_text(c: Column, kind: str) -> Column:
    """Text of a reference cell: null is empty, whole numbers have no decimals."""
    if kind in ("double", "float"):
        return F.coalesce(F.when(c == F.floor(c), c.cast("bigint").cast("string")).otherwise(c.cast("string")), F.lit(""))
    return F.coalesce(c.cast("string"), F.lit(""))


def reference_link(c: Column) -> Column:
    """(kind, label, url) of a reference: a DOI with its special characters quoted, a PubMed id, a web address, or plain text."""
    kind, doi = reference_kind(c), doi_text(c)
    digits = F.regexp_extract(doi, r"(\d+)$", 1)
    url = (
        F.when(kind == "doi", F.concat(F.lit("https://doi.org/"), F.regexp_replace(F.url_encode(doi), "%2F", "/")))
        .when(kind == "pmid", F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), digits, F.lit("/")))
        .when(kind == "url", F.trim(c))
    )
    label = F.when(kind == "doi", doi).when(kind == "pmid", F.concat(F.lit("PMID "), digits)).otherwise(F.trim(c))
    return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), label.alias("label"), url.alias("url")))


def document_links(doi: Column, pubmed: Column, patent: Column) -> Column:
    """Links of a document: DOI, PubMed, patent number without hyphens; those that it has."""
    named = lambda kind, value, url: F.when(value != "", F.struct(F.lit(kind).alias("kind"), url.alias("url")))
    d, n, p = doi_text(doi), F.regexp_extract(F.coalesce(pubmed.cast("string"), F.lit("")), r"^\s*(\d+)", 1), F.regexp_replace(F.trim(patent), "-", "")
    return F.filter(
        F.array(
            named("doi", d, F.concat(F.lit("https://doi.org/"), F.regexp_replace(F.url_encode(d), "%2F", "/"))),
            named("pubmed", n, F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), n, F.lit("/"))),
            named("patent", p, F.concat(F.lit("https://patents.google.com/patent/"), p)),
        ),
        lambda x: x.isNotNull(),
    )


def value_text(values: Column, decimals: int = 2) -> Column:
    """Distinct values in ascending order with fixed decimals, joined; zero has no sign."""
    return F.array_join(F.transform(F.array_sort(F.array_distinct(F.transform(values, lambda x: x + 0.0))), lambda x: F.format_string(f"%.{decimals}f", x)), "; ")


def bucket(share: Column, steps: list[float], names: list[str]) -> Column:
    """Name of the left-closed band of a share; ``names`` is one longer than ``steps``."""
    out = F.lit(names[-1])
    for s, n in reversed(list(zip(steps, names, strict=False))):
        out = F.when(share < s, n).otherwise(out)
    return F.when(share.isNotNull(), out)


def clusters_by_source(records: DataFrame, rounds: int = 30) -> DataFrame:
    """(entry, cluster): entries connected by shared documents; the cluster is its least entry.

    Labels spread through documents and entries by turns, as aggregates, until a round changes nothing.
    """
    links = records.where("entry is not null and document is not null").select("entry", "document").distinct().cache()
    label = links.select("entry").distinct().withColumn("cluster", F.col("entry"))
    last = None
    for _ in range(rounds):
        before = label
        least = links.join(label, "entry").groupBy("document").agg(F.min("cluster").alias("c"))
        label = links.join(least, "document").groupBy("entry").agg(F.min("c").alias("cluster")).cache()
        state = label.agg(F.sum(F.col("cluster").cast("decimal(38,0)"))).first()[0]
        before.unpersist()
        if state == last:
            break
        last = state
    else:
        raise ValueError(f"labels did not settle in {rounds} rounds")
    return label


def external_vectors(table: DataFrame, key: str, prefix: str) -> DataFrame:
    """(id, v) from the columns that start with a prefix, in the order of their names; cells that are no numbers are an error."""
    names = sorted(c for c in table.columns if c.startswith(prefix))
    if not names:
        raise ValueError(f"no column starts with {prefix}")
    cells = F.array(*(clean_double(F.col(f"`{c}`")) for c in names))
    whole = F.when(F.exists(cells, lambda x: x.isNull()), F.raise_error(F.lit("a cell is no finite number"))).otherwise(cells)
    return table.select(F.col(key).alias("id"), whole.alias("v"))


def entity_key(table: DataFrame, candidates: list[str], fallback: str) -> str:
    """The first candidate column that is filled and distinct in all rows, else the fallback."""
    held = [c for c in candidates if c in table.columns]
    if held:
        row = table.agg(F.count(F.lit(1)).alias("n"), *(F.countDistinct(c).alias(f"d{i}") for i, c in enumerate(held))).first()
        for i, c in enumerate(held):
            if row[f"d{i}"] == row["n"]:
                return c
    return fallback
