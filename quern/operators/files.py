"""Files and logs as tables: retention of daily files, web-log counts, queries over a file index, changes worth showing."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: The extensions of each category of files.
EXTENSIONS = {
    "document": "doc docx wps xls xlsx et csv tsv ppt pptx dps pdf txt md rtf json xml yaml yml html htm log one epub mobi".split(),
    "image": "jpg jpeg png gif bmp webp svg ico tif tiff psd ai heic heif raw cr2 nef arw dng".split(),
    "video": "mp4 mkv avi mov wmv flv webm m4v mpg mpeg rm rmvb m2ts 3gp".split(),
    "audio": "mp3 wav flac aac ogg oga wma m4a ape opus mid midi amr".split(),
    "archive": "zip rar 7z tar gz tgz bz2 xz iso cab zst lz4 jar".split(),
}
#: What a robot's agent holds, an updater's agent holds, and rows of a page by default and at most.
ROBOTS = "bot|spider|crawl|scan|curl|wget|python-requests|zgrab|masscan|headless"
UPDATERS = "electron-updater|electron-builder"
PAGE, MOST = 100, 500
SORTS = {"name": "name", "path": "path", "size": "size", "extension": "extension", "date-modified": "modified"}
LINE = r'^(\S+) \S+ \S+ \[([^\] ]+)[^\]]*\] "\S+ (\S+)[^"]*" \d+ \S+ "[^"]*" "([^"]*)"'


def daily_date(name: Column) -> Column:
    """The date of a daily file; null unless the name is a real date and ``.log``, nothing else."""
    return F.when(name.rlike(r"\A\d{4}-\d{2}-\d{2}\.log\z"), F.substring(name, 1, 10).try_cast("date"))


def expired_daily_files(files: DataFrame, name: str, today: dt.date, days: float) -> DataFrame:
    """Daily files older than ``days`` days, of which today is the first; other files are never among them."""
    kept = max(1, min(3650, int(days)))
    return files.where(daily_date(F.col(name)) < F.lit(today - dt.timedelta(days=kept - 1)))


def web_log_rows(lines: DataFrame, line: str = "line") -> DataFrame:
    """``lines`` with ip, at (the server's wall clock), target and agent of combined web-log lines; other lines are left out."""
    part = lambda k: F.regexp_extract(line, LINE, k)
    at = F.try_to_timestamp(part(2), F.lit("dd/MMM/yyyy:HH:mm:ss")).cast("timestamp_ntz")
    return lines.where(F.col(line).rlike(LINE)).withColumns({"ip": part(1), "at": at, "target": part(3), "agent": part(4)}).where("at IS NOT NULL")


def counted_requests(lines: DataFrame, log: str = "log", line: str = "line") -> DataFrame:
    """metric, at, hour, ip, agent, file and robot of the requests in the logs access, clicks and downloads that count; what is no page and no installer isn't looked at."""
    path = F.regexp_extract("target", r"^[^?#]*", 0)
    page = path.isin("/", "/download", "/guide") | path.endswith(".html")
    installer = ~(path.endswith("/latest.yml") | path.endswith(".blockmap"))
    metric = (
        F.when((F.col(log) == "access") & page, "page_view")
        .when(F.col(log) == "clicks", "web_click")
        .when((F.col(log) == "downloads") & installer, F.when(F.col("agent").rlike(UPDATERS), "app_update").otherwise("web_download_local"))
    )
    file = F.when(F.col(log) == "clicks", F.col("target")).otherwise(path)
    robot = F.col("agent").isin("", "-") | F.lower("agent").rlike(ROBOTS)
    return web_log_rows(lines, line).select(metric.alias("metric"), "at", F.date_trunc("hour", "at").alias("hour"), "ip", "agent", file.alias("file"), robot.alias("robot")).where("metric IS NOT NULL")


def web_log_counts(lines: DataFrame, log: str = "log", line: str = "line") -> DataFrame:
    """(day, metric, n, filtered_bots) of the logs access, clicks and downloads.

    Requests of one address and agent for one file count once an hour. Robots and empty agents don't count, their number is
    kept beside. Aggregates twice on fine keys, so no day is one task's.
    """
    once = counted_requests(lines, log, line).groupBy("metric", "hour", "ip", "agent", "file", "robot").agg(F.count("*").alias("k"))
    return once.groupBy(F.col("hour").cast("date").alias("day"), "metric").agg(F.count_if(~F.col("robot")).alias("n"), F.sum(F.when(F.col("robot"), F.col("k")).otherwise(0)).alias("filtered_bots"))


def find_files(index: DataFrame, words: str | None, category: str = "all", sort: str = "date-modified", descending: bool = True, offset: int = 0, size: int = PAGE) -> DataFrame:
    """A page of the files of ``index`` (path, name, extension, size, modified, is_folder) whose names hold all words.

    Unknown categories mean all files, unknown sorts the newest first; without words and category there is no result. Ties go
    by path. A word may be ``ext:a;b`` or ``folder:``.
    """
    terms = (words or "").split()
    category = category if category == "folder" or category in EXTENSIONS else "all"
    if not terms and category == "all":
        return index.limit(0)

    def fits(term: str) -> Column:
        term = term.strip("<>").lower()
        if term.startswith("ext:"):
            return F.lower("extension").isin(*[x for x in term[4:].split(";") if x])
        return F.col("is_folder") if term == "folder:" else F.contains(F.lower("name"), F.lit(term))

    if category != "all":
        terms.append("folder:" if category == "folder" else "ext:" + ";".join(EXTENSIONS[category]))
    key, descending = (SORTS[sort], descending) if sort in SORTS else ("modified", True)
    order = F.desc(key) if descending else F.asc(key)
    found = index.where(reduce(lambda a, b: a & b, map(fits, terms)))
    return found.orderBy(order, "path").offset(max(0, offset)).limit(min(size, MOST) if size > 0 else PAGE)


def worth_showing(before: str, after: str) -> Column:
    """Whether a change of a file shows: structs of exists, hash, text and preview. Existence decides, then hashes if both are known, then texts (or previews) with line ends alike if any is known; else it does."""
    a, b = (lambda f: F.col(f"{before}.{f}")), (lambda f: F.col(f"{after}.{f}"))
    text = lambda side: F.replace(F.coalesce(side("text"), side("preview"), F.lit("")), F.lit("\r\n"), F.lit("\n"))
    known = a("text").isNotNull() | b("text").isNotNull() | a("preview").isNotNull() | b("preview").isNotNull()
    return (
        F.when(a("exists") != b("exists"), True)
        .when(~a("exists"), False)
        .when(a("hash").isNotNull() & b("hash").isNotNull(), a("hash") != b("hash"))
        .when(known, text(a) != text(b))
        .otherwise(True)
    )
