"""Paced remote sources as Python data sources: one partition, one request at a time, a pluggable fetch."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Seconds between requests by host kind.
PACES = {"preprints": 3.0, "catalogue": 0.5, "registry": 0.5}
UNKNOWN_PACE = 1.0
RETRIES = 3
# End.


def retry_after(header: str | None, floor: float, ceiling: float) -> float:
    """Seconds a server asks to wait, between floor and ceiling."""
    try:
        asked = float(header) if header else floor
    except ValueError:
        asked = floor
    return min(max(asked, floor), ceiling)


class Gate:
    """Lets requests to a host pass no closer than its pace; the clock can be replaced in tests."""

    def __init__(self, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.clock, self.sleep, self.last = clock, sleep, {}

    def wait(self, host: str) -> float:
        pace = PACES.get(host, UNKNOWN_PACE)
        due = self.last.get(host, -pace) + pace
        pause = max(0.0, due - self.clock())
        if pause:
            self.sleep(pause)
        self.last[host] = self.clock()
        return pause


def file_fetch(path: str) -> Callable[[str], str | None]:
    """A fetch over a JSON file of canned answers, {request: answer}; it needs no network."""
    with open(path, encoding="utf-8") as f:
        answers = json.load(f)
    return lambda request: json.dumps(answers[request]) if request in answers else None


def in_batches(items: list[str], size: int) -> list[list[str]]:
    return [items[i: i + size] for i in range(0, len(items), size)]


class RecordSource(DataSource):
    """``spark.read.format("records")``: answers to ``requests`` (JSON list) at ``host`` from ``answers`` (file) or HTTP at ``base``."""

    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        return "request string, body string"

    def reader(self, schema) -> "RecordReader":
        return RecordReader(self.options)


class RecordReader(DataSourceReader):
    def __init__(self, options):
        self.requests = json.loads(options.get("requests", "[]"))
        self.host, self.answers, self.base = options.get("host", ""), options.get("answers"), options.get("base", "")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]  # one: the pace holds for the whole query

    def read(self, partition):
        gate = Gate()
        fetch = file_fetch(self.answers) if self.answers else self._http
        for request in self.requests:
            if not self.answers:
                gate.wait(self.host)
            if (body := fetch(request)) is not None:
                yield request, body

    def _http(self, request: str) -> str | None:
        import urllib.error
        import urllib.request

        for attempt in range(RETRIES):
            try:
                with urllib.request.urlopen(self.base + request, timeout=20) as answer:
                    return answer.read().decode("utf-8", "replace")
            except urllib.error.HTTPError as e:
                if e.code == 404:
                    return None
                if e.code not in (429, 500, 502, 503) or attempt == RETRIES - 1:
                    raise
                time.sleep(retry_after(e.headers.get("Retry-After"), 1.0, 60.0))
        return None


def strict_query(terms: list[str]) -> str:
    """All terms in the abstract."""
    return " AND ".join(f"abs:{t}" for t in terms)


def phrase_query(topic: str, most: int = 6) -> str:
    """The topic's first words as a title phrase."""
    return 'ti:"' + " ".join(topic.split()[:most]) + '"'


def broad_query(terms: list[str]) -> str:
    """Any term anywhere."""
    return " OR ".join(f"all:{t}" for t in terms)


def title_query(title: str, author: str = "", year: int | None = None) -> str:
    """A named paper: its title as a phrase, with author and year where they are known."""
    parts = [f'ti:"{" ".join(title.split())}"'] if title.strip() else []
    parts += [f'au:"{author.strip()}"'] if author.strip() else []
    parts += [f"submittedDate:[{year - 1}01010000 TO {year}12312359]"] if year else []
    return " AND ".join(parts)


def fallback_query(title: str, author: str = "") -> str | None:
    """The words of a title one by one, with the author; None without a title."""
    words = [w for w in title.split() if len(w) > 3]
    return " AND ".join([*(f"ti:{w}" for w in words), *([f'au:"{author.strip()}"'] if author.strip() else [])]) if words else None


def loose_query(title: str, author: str = "") -> str | None:
    """Any long word of a title anywhere, with the author; None without one."""
    words = [w for w in title.split() if len(w) > 4]
    any_word = " OR ".join(f"all:{w}" for w in words)
    return (f"({any_word}) AND au:\"{author.strip()}\"" if author.strip() else any_word) if words else None


def filters(categories: list[str] = (), since: str = "") -> str:
    """Category and date conditions to put behind a query; '' without any."""
    out = [f"({' OR '.join(f'cat:{c}' for c in categories)})"] if categories else []
    out += [f"submittedDate:[{since.replace('-', '')}0000 TO 999912312359]"] if since else []
    return "".join(f" AND {x}" for x in out)


ATOM = "id string, title string, summary string, published string, author array<struct<name:string>>, doi string, journal_ref string, comment string"
HIT = (
    "metadata struct<control_number:bigint,titles:array<struct<title:string>>,authors:array<struct<full_name:string>>,publication_info:array<struct<journal_title:string,journal_volume:string,year:int,page_start:string,page_end:string,artid:string,material:string>>,"
    "dois:array<struct<value:string,material:string>>,arxiv_eprints:array<struct<value:string>>,citation_count:int,document_type:array<string>,number_of_pages:int,abstracts:array<struct<value:string>>>"
)


def feed_entries(answers):
    """Entries of the Atom feeds in ``body``: (request, arxiv_id, version, title, authors, year, summary, doi, journal_ref, comment)."""
    from pyspark.sql import functions as F

    entries = F.regexp_extract_all(F.regexp_replace("body", r"<(/?)[a-z]+:", "<$1"), F.lit(r"(?s)(<entry>.*?</entry>)"), F.lit(1))
    rows = answers.select("request", F.explode(entries).alias("entry")).select("request", F.from_xml("entry", ATOM).alias("e")).select("request", "e.*")
    tail = F.regexp_extract("id", r"abs/(.+)$", 1)
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return rows.select(
        "request", F.regexp_replace(tail, r"v[0-9]+$", "").alias("arxiv_id"), F.regexp_extract(tail, r"(v[0-9]+)$", 1).alias("version"), squeeze("title").alias("title"),
        F.transform("author", lambda a: a["name"]).alias("authors"), F.substring("published", 1, 4).try_cast("int").alias("year"), squeeze("summary").alias("summary"), "doi", "journal_ref", "comment",
    )


def catalogue_hits(answers):
    """Records of a catalogue's answers: (request, total, metadata); one record by path or the hits of a search, a broken answer gives none."""
    from pyspark.sql import functions as F

    search = F.from_json("body", f"hits struct<total:bigint,hits:array<struct<{HIT.replace('metadata struct', 'metadata:struct', 1)}>>>")
    single = F.from_json("body", HIT)
    rows = answers.select("request", search.alias("s"), single.alias("r"))
    many = rows.filter("s.hits.hits is not null").select("request", F.col("s.hits.total").alias("total"), F.explode("s.hits.hits").alias("h")).select("request", "total", "h.metadata")
    return many.unionByName(rows.filter("r.metadata is not null").select("request", F.lit(1).cast("long").alias("total"), "r.metadata"))


def registry_works(answers):
    """Works of a DOI registry's answers in the fields of a stored work: (request, title, authors, year, journal, doi)."""
    from pyspark.sql import functions as F

    kind = "message struct<DOI:string,title:array<string>,author:array<struct<given:string,family:string>>,`container-title`:array<string>,volume:string,page:string,issued:struct<`date-parts`:array<array<int>>>>"
    m = F.col("m.message")
    rows = answers.select("request", F.from_json("body", kind).alias("m")).filter("m.message is not null")
    year = F.get(F.get(m["issued"]["date-parts"], F.lit(0)), F.lit(0))
    first_page = F.nullif(F.regexp_extract(F.coalesce(m["page"], F.lit("")), "^([^-]+)", 1), F.lit(""))
    journal = F.concat_ws(" ", F.get(m["container-title"], F.lit(0)), m["volume"], F.concat(F.lit("("), year.cast("string"), F.lit(")")), first_page)
    return rows.select("request", F.get(m["title"], F.lit(0)).alias("title"), F.transform(m["author"], lambda a: F.concat_ws(", ", a["family"], a["given"])).alias("authors"), year.alias("year"), journal.alias("journal"), F.lower(m["DOI"]).alias("doi"))


def batched(keys, column: str, size: int, request):
    """(request): requests of at most ``size`` distinct keys each; ``request`` makes one of a column with the keys' array.

    Keys are numbered within hash buckets, so a batch is made where its keys are and nothing is gathered.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    rows = keys.select(F.col(column).cast("string").alias("k")).filter("coalesce(k, '') <> ''").distinct()
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("k"), F.lit(256)))
    at = F.floor((F.row_number().over(Window.partitionBy("bucket").orderBy("k")) - 1) / size)
    groups = rows.withColumn("at", at).groupBy("bucket", "at").agg(F.sort_array(F.collect_list("k")).alias("ks"))
    return groups.select(request(F.col("ks")).alias("request"))


class SharedGate:
    """A gate that several processes of one machine share through a locked file below a collection.

    A damaged state counts as empty; where the folder cannot be written only this process is paced and
    ``local_only`` says so; nobody waits longer than ``limit`` seconds.
    """

    def __init__(self, root: str, limit: float = 120.0, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep):
        self.path, self.limit, self.clock, self.sleep = f"{root}/.gate.json", limit, clock, sleep
        self.own, self.local_only = Gate(clock, sleep), False

    def wait(self, host: str) -> float:
        import fcntl

        try:
            handle = open(self.path, "a+", encoding="utf-8")
        except OSError:
            self.local_only = True
            return self.own.wait(host)
        with handle:
            began = self.clock()
            while True:
                try:
                    fcntl.flock(handle, fcntl.LOCK_EX | fcntl.LOCK_NB)
                    break
                except BlockingIOError:
                    if self.clock() - began > self.limit:
                        raise TimeoutError(f"the gate at {self.path} stayed shut for {self.limit} seconds") from None
                    self.sleep(0.1)
            handle.seek(0)
            try:
                state = {k: float(v) for k, v in json.loads(handle.read() or "{}").items()}
            except (ValueError, AttributeError, TypeError):
                state = {}
            pace = PACES.get(host, UNKNOWN_PACE)
            pause = min(max(0.0, state.get(host, 0.0) + pace - self.clock()), pace, self.limit)
            if pause:
                self.sleep(pause)
            state[host] = self.clock()
            handle.seek(0)
            handle.truncate()
            handle.write(json.dumps(state))
        return pause
