"""The library's logs and documents: manifest folds, coverage, links, keyword classes, folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import name_key, normal_url

GOOD = ("fetched", "unchanged", "manual")
#: Document classes and their keywords, and words of file or folder names that hint at them.
KEYWORDS = {
    "listing": ("design no", "restrained", "assembly rating", "fire resistance"),
    "chart": ("thickness", "w/d", "rating", "beam"),
    "drawing": ("scale", "sheet", "elevation", "level"),
    "license": ("license", "released under", "version"),
}
HINTS = {"listing": "src1", "chart": "src2", "drawing": "src3", "license": "src4"}


def manifest_latest(log: DataFrame) -> DataFrame:
    """The last good record of each URL; a later event of equal time wins."""
    good = log.filter(F.col("status").isin(*GOOD) & F.col("url").isNotNull() & F.col("stored_path").isNotNull())
    return good.groupBy("url").agg(F.max(F.struct("fetched_at", "event_id", "status", "stored_path")).alias("r")).select("url", "r.*")


def manifest_previous(asked: DataFrame, log: DataFrame) -> DataFrame:
    """For each (url, source_id) asked, the latest good record by URL, else by id."""
    good = log.filter(F.col("status").isin(*GOOD))
    by_url = good.groupBy("url").agg(F.max(F.struct("fetched_at", "event_id")).alias("u"))
    by_id = good.groupBy("source_id").agg(F.max(F.struct("fetched_at", "event_id")).alias("i"))
    joined = asked.select("url", "source_id").distinct().join(by_url, "url", "left").join(by_id, "source_id", "left")
    return joined.select("url", "source_id", F.coalesce("u.event_id", "i.event_id").alias("previous_event"), F.when(F.col("u").isNotNull(), "url").when(F.col("i").isNotNull(), "id").alias("found_by"))


def manufacturer_of(stored_path: Column, url: Column) -> Column:
    """The first folder of the stored path, else the URL's host."""
    return F.coalesce(F.nullif(F.split_part(stored_path, F.lit("/"), F.lit(1)), F.lit("")), F.try_parse_url(url, F.lit("HOST")))


def coverage(manifest: DataFrame, routed: DataFrame) -> DataFrame:
    """By manufacturer: documents, routed kinds, designs with and without tables, chart rows."""
    latest = manifest_latest(manifest).select("url", manufacturer_of(F.col("stored_path"), F.col("url")).alias("manufacturer"))
    documents = latest.groupBy("manufacturer").agg(F.count("*").alias("documents"))
    r = routed.join(latest, "url", "left").withColumn("manufacturer", F.coalesce("manufacturer", F.try_parse_url("url", F.lit("HOST"))))
    listing = F.col("kind") == "listing"
    designs = r.filter(listing).groupBy("manufacturer", "design").agg(F.max("n_tables").alias("t"))
    tables = designs.groupBy("manufacturer").agg(F.count_if(F.col("t") > 0).alias("designs_with_tables"), F.count_if(F.col("t") == 0).alias("designs_without_tables"))
    kinds = r.groupBy("manufacturer").agg(F.count_if(F.col("kind") == "chart").alias("charts"), F.count_if(listing).alias("listings"), F.coalesce(F.sum(F.when(F.col("kind") == "chart", F.col("n_rows"))), F.lit(0)).alias("chart_rows"))
    joined = documents.join(kinds, "manufacturer", "full").join(tables, "manufacturer", "full")
    return joined.select("manufacturer", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("documents", "charts", "listings", "chart_rows", "designs_with_tables", "designs_without_tables")])


def links(pages: DataFrame) -> DataFrame:
    """Distinct link targets of each page, absolute ones with scheme and host in lower case."""
    found = pages.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)))).alias("href"))
    return found.withColumn("href", F.when(F.col("href").rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), normal_url(F.col("href"))).otherwise(F.col("href"))).distinct()


def new_links(found: DataFrame, registry: DataFrame) -> DataFrame:
    """Targets that the registry does not have, with the pages that name them counted."""
    return found.join(registry.select("href").distinct(), "href", "left_anti").groupBy("href").agg(F.count_distinct("page_id").alias("n_pages"))


def crawl_order(seeds: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """Pages reached from seeds over links (src, dst), each with its least depth: breadth first, a level a round."""
    level = seeds.select(F.col("url")).distinct().withColumn("depth", F.lit(0))
    seen = level
    for d in range(1, depth + 1):
        fresh = level.join(edges, level["url"] == edges["src"]).select(F.col("dst").alias("url")).distinct()
        level = fresh.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(d))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def matched_drops(dropped: DataFrame, registry: DataFrame) -> DataFrame:
    """Dropped files with the first registry entry whose name has the same letters and digits; null if none."""
    first = registry.withColumn("key", name_key(F.col("file_name"))).groupBy("key").agg(F.min(F.struct("ord", "id")).alias("f"))
    return dropped.withColumn("key", name_key(F.col("name"))).join(first, "key", "left").select("name", F.col("f.id").alias("registry_id"))


def _passes(words: list[str]) -> list[list[str]]:
    """Keywords in as few scans as find them all: within a scan none begins inside another and ends outside it."""
    def crossed(a: str, b: str) -> bool:
        return any(a.endswith(b[:n]) or b.endswith(a[:n]) for n in range(1, min(len(a), len(b)))) and a not in b and b not in a

    out: list[list[str]] = []
    for w in sorted(words, key=lambda w: (-len(w), w)):
        place = next((p for p in out if not any(crossed(w, x) for x in p)), None)
        if place is None:
            out.append([w])
        else:
            place.append(w)
    return out


def keyword_scores(texts: DataFrame, key: str, text: str, folder: str) -> DataFrame:
    """Score of each class: occurrences of its keywords, five of each at most, and 3 for a hinting folder. No join.

    A text is scanned once for keywords that do not cross each other, the longest first; one that lies inside another counts with it.
    """
    passes = _passes(sorted({w for ws in KEYWORDS.values() for w in ws}))
    quoted = lambda w: "".join("\\" + c if not c.isalnum() and c != " " else c for c in w)
    counted = lambda column, names: F.size(F.filter(column, lambda h: h.isin(names)))
    found = {}
    rows = texts.select(F.col(key), F.col(folder).alias("_folder"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_low"))
    for k, ws in enumerate(passes):
        pattern = rf"(?<![a-z0-9])(?:{'|'.join(map(quoted, ws))})(?![a-z0-9])"
        rows = rows.withColumn(f"_hits{k}", F.regexp_extract_all("_low", F.lit(pattern), F.lit(0)))
        for w in ws:
            found[w] = counted(f"_hits{k}", [x for x in ws if f" {w} " in f" {x} "])
    scores = []
    for name, words in KEYWORDS.items():
        hits = sum((F.least(found[w], F.lit(5)) for w in words), F.lit(0))
        scores.append((hits + F.when(F.col("_folder") == HINTS[name], 3).otherwise(0)).cast("long").alias(f"score_{name}"))
    return rows.select(F.col(key), *scores)


def classify(scores: DataFrame, key: str) -> DataFrame:
    """The best class, if its score is 2 or more and its confidence 0.45 or more: 0.3 + 0.1 best - 0.05 second, 0.95 at most."""
    names = sorted(KEYWORDS)
    ranked = F.array_sort(F.array(*[F.struct((-F.col(f"score_{n}")).alias("s"), F.lit(n).alias("n")) for n in names]))
    best, second = -ranked[0]["s"], -ranked[1]["s"]
    sure = F.least(F.greatest(F.lit(0.3) + best * 0.1 - second * 0.05, F.lit(0.0)), F.lit(0.95))
    return scores.select(F.col(key), best.alias("best_score"), sure.alias("confidence"), F.when((sure >= 0.45 - 1e-9) & (best >= 2), ranked[0]["n"]).otherwise("unclassified").alias("doc_class"))


def by_folder(entries: DataFrame, folder: str, size: str) -> DataFrame:
    """Files and bytes by folder."""
    return entries.groupBy(F.col(folder).alias("folder")).agg(F.count("*").alias("files"), F.sum(size).alias("bytes"), F.max(size).alias("largest"))


def count_by(entries: DataFrame, key: Column, name: str) -> DataFrame:
    return entries.groupBy(key.alias(name)).agg(F.count("*").alias("n"))


def by_decade(entries: DataFrame, year: Column) -> DataFrame:
    return count_by(entries, year - year % 10, "decade")


def unpivoted_grid(grid: DataFrame, keys: list[str], ratings: list[str]) -> DataFrame:
    """A wide thickness sheet as tidy rows: one for each rating column that holds a value."""
    return grid.unpivot(keys, ratings, "rating", "printed").filter("printed is not null")


def deduplicated_charts(charts: DataFrame) -> DataFrame:
    """The first chart of each content hash."""
    w = Window.partitionBy("sha256").orderBy("ord")
    return charts.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def current_stock(events: DataFrame) -> DataFrame:
    """Idempotent imports: the first event of each URL and content hash is new, later ones unchanged."""
    w = Window.partitionBy("url", "sha256").orderBy("ts", "event_id")
    return events.withColumn("state", F.when(F.row_number().over(w) == 1, "new").otherwise("unchanged"))


def url_filter(rows: DataFrame, part: str | None = None, pdf_only: bool = False) -> DataFrame:
    """Rows whose url holds `part`, in any case, and, if asked, whose path ends in .pdf."""
    url = F.lower("url")
    held = url.contains(part.lower()) if part else F.lit(True)
    return rows.filter(held & F.regexp_extract(url, r"^[^?#]*", 0).endswith(".pdf") if pdf_only else held)


def allowed_urls(rows: DataFrame, hosts: list[str]) -> DataFrame:
    """Rows whose url is http or https and whose host is listed; the list is a parameter, so it stays in the plan."""
    host = F.regexp_extract(F.lower("url"), r"^https?://(?:[^/@?#]*@)?([^/:?#]+)", 1)
    return rows.filter(host.isin([h.lower() for h in hosts]))


#: System files that a walk passes over.
SKIPPED_NAMES = (".DS_Store", "Thumbs.db", "desktop.ini", ".Spotlight-V100", ".Trashes", ".fseventsd")


def walked(rows: DataFrame, path: str = "path", excludes: tuple[str, ...] = (), names: tuple[str, ...] = SKIPPED_NAMES) -> DataFrame:
    """Rows whose path a walk reaches: no system name, no hidden folder, no lock or resource file, no excluded glob."""
    parts = F.split(F.col(path), "/")
    file = F.element_at(parts, -1)
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    keep = ~F.exists(parts, lambda p: p.isin(list(names))) & ~F.exists(folders, lambda p: p.startswith(".") & (F.length(p) > 1)) & ~file.startswith("._") & ~file.startswith("~$")
    for glob in excludes:
        keep = keep & ~F.col(path).rlike("^" + "".join({"*": ".*", "?": "."}.get(c, "\\" + c if not c.isalnum() and c != "/" else c) for c in glob) + "$")
    return rows.filter(keep)


def top_classes(scores: DataFrame, key: str, most: int = 5) -> DataFrame:
    """The best `most` classes of each row with a score above 0, by score, then name."""
    ranked = F.array_sort(F.array(*[F.struct((-F.col(f"score_{n}")).alias("s"), F.lit(n).alias("n")) for n in sorted(KEYWORDS)]))
    best = F.slice(F.filter(ranked, lambda r: r["s"] < 0), 1, most)
    return scores.select(F.col(key), F.posexplode(best).alias("rank", "r")).select(key, (F.col("rank") + 1).alias("rank"), F.col("r.n").alias("doc_class"), (-F.col("r.s")).alias("score"))


def rows_by(rows: DataFrame, column: str) -> DataFrame:
    """Rows for each value, the most common first, with its rank."""
    counted = rows.groupBy(column).agg(F.count("*").alias("n"))
    return counted.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), column)))


def filled_across(cells: DataFrame, row: list[str], order: str, column: str) -> DataFrame:
    """Labels printed once for several columns, carried to the right within their row."""
    w = Window.partitionBy(*row).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumn(f"{column}_filled", F.last(column, ignorenulls=True).over(w))


def header_groups(lines: DataFrame, by: list[str], line: str = "line", gap: int = 3) -> DataFrame:
    """Header lines in groups: a new one where the line is more than `gap` below the one before."""
    w = Window.partitionBy(*by).orderBy(line)
    fresh = F.when(F.col(line) - F.lag(line).over(w) <= gap, 0).otherwise(1)
    return lines.withColumn("_new", fresh).withColumn("header_group", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def hour_groups(cells: DataFrame, by: list[str], order: str, hours: str = "hours") -> DataFrame:
    """Columns of ratings in groups: a new one where the hours do not rise."""
    w = Window.partitionBy(*by).orderBy(order)
    fresh = F.when(F.col(hours) > F.lag(hours).over(w), 0).otherwise(1)
    return cells.withColumn("_new", fresh).withColumn("column_group", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
