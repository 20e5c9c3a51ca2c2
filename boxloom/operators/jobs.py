"""Jobs, logs, traces and archives: states, plans, limits and reports."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxloom.functions import text as tx
from boxloom.functions.staging import staged
from boxloom.operators.group import PAGE
from boxloom.operators.ranking import position_block, split_row_number, split_running

JOB = ("job_id",)
# Fixed values
RERUN_ALIASES = {"ocr_merge": "ocr_structured", "ocr_raw": "ocr_raw", "ocr_merged": "ocr_structured",
                 "ocr_structured": "ocr_structured", "alt_placement": "alt_placement", "translations": "translations",
                 "placements": "placements", "render": "render"}
TERMINAL = ("complete", "failed", "cancelled")
MOST_PAGES = 10_000


@dataclass(frozen=True)
class ArchiveLimits:
    members: int = 10_000
    image_pages: int = 2_000
    member_bytes: int = 512 * 1024 * 1024
    total_bytes: int = 20 * 1024 * 1024 * 1024
    preserved_member_bytes: int = 64 * 1024 * 1024
    preserved_total_bytes: int = 256 * 1024 * 1024


# pages -----------------------------------------------------------------------------------

def page_range(pages: DataFrame, start: int = 0, end: int | None = None) -> DataFrame:
    kept = pages.where(F.col("page") >= start)
    return kept if end is None else kept.where(F.col("page") <= end)


def pages_before(pages: DataFrame, page: int) -> DataFrame:
    return pages.where(F.col("page") < page)


def pages_except(pages: DataFrame, page: int) -> DataFrame:
    return pages.where(F.col("page") != page)


def page_selection(requests: DataFrame, most: int = MOST_PAGES) -> tuple[DataFrame, DataFrame]:
    """Pages of selections like `0-3,7`: (request_id, page) and (request_id, code)."""
    parts = requests.select("request_id", F.explode(F.split("selection", ",")).alias("part")).withColumn("part", tx.strip(F.col("part")))
    bounds = F.split("part", "-", 2)
    ranged = F.contains("part", F.lit("-"))
    low = F.when(ranged, tx.strip(F.get(bounds, F.lit(0)))).otherwise(F.col("part"))
    high = F.when(ranged, tx.strip(F.get(bounds, F.lit(1)))).otherwise(F.col("part"))
    digits = F.lit(r"^\p{Nd}+$")
    read = parts.where("part <> ''").select("request_id", low.try_cast("bigint").alias("a"), high.try_cast("bigint").alias("z"),
                                            ranged.alias("ranged"), (F.rlike(low, digits) & F.rlike(high, digits)).alias("plain"))
    code = (F.when(~F.col("plain") | F.col("a").isNull() | F.col("z").isNull(), F.when(F.col("ranged"), "bad_range").otherwise("bad_page"))
            .when(F.col("z") < F.col("a"), "descending").when(F.col("z") - F.col("a") + 1 > most, "too_many"))
    judged = read.withColumn("code", code)
    wrong = judged.where(F.col("code").isNotNull()).groupBy("request_id").agg(F.min("code").alias("code"))
    empty = requests.select("request_id").join(read.select("request_id").distinct(), "request_id", "left_anti").withColumn("code", F.lit("empty"))
    pages = (judged.where(F.col("code").isNull()).join(wrong.select("request_id"), "request_id", "left_anti")
             .select("request_id", F.explode(F.sequence("a", "z")).alias("page")).distinct())
    many = pages.groupBy("request_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("request_id", F.lit("too_many").alias("code"))
    return pages.join(many.select("request_id"), "request_id", "left_anti"), wrong.unionByName(empty).unionByName(many)


def missing_artifacts(pages: DataFrame, artifacts: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Pages without a row of one of the `kinds` of artifact that every page must have (`artifacts`: book_id, page, artifact)."""
    wanted = F.explode(F.array(*[F.lit(k) for k in kinds])).alias("artifact")
    return pages.select(*PAGE).distinct().select(*PAGE, wanted).join(artifacts.select(*PAGE, "artifact").distinct(), [*PAGE, "artifact"], "left_anti")


def resume_page(requests: DataFrame, pages: DataFrame, done: DataFrame) -> DataFrame:
    """First page before the requested one that lacks its output, else the requested page."""
    missing = pages.select(*PAGE).join(done.select(*PAGE).distinct(), list(PAGE), "left_anti")
    first = missing.groupBy("book_id").agg(F.min("page").alias("gap"))  # the first before any page is the first of the book
    return requests.select("book_id", F.col("page").alias("asked")).join(first, "book_id", "left").select(
        "book_id", "asked", F.when(F.col("gap") < F.col("asked"), F.col("gap")).otherwise(F.col("asked")).alias("page"))


def pages_to_finish(pages: DataFrame, pending: DataFrame, rendered: DataFrame) -> DataFrame:
    """Pages with pending edits and pages that were never rendered."""
    unrendered = pages.select(*PAGE).join(rendered.select(*PAGE).distinct(), list(PAGE), "left_anti")
    return pending.select(*PAGE).join(pages.select(*PAGE), list(PAGE), "left_semi").unionByName(unrendered).distinct()


def rerun_plan(requests: DataFrame, counts: DataFrame, default: str, per_page: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(book_id, page, phase) to run again and errors.

    `requests`: book_id, pages (array, empty for all); `counts`: book_id, page_count;
    `per_page`: book_id, page, stage that differs from the default.
    """
    sized = requests.join(counts, "book_id", "left").withColumn("page_count", F.coalesce("page_count", F.lit(0)))
    none = sized.where("page_count <= 0").select("book_id", F.lit("no_pages").alias("code"), F.lit(None).cast("bigint").alias("page"))
    open_books = sized.where("page_count > 0")
    every = F.sequence(F.lit(0).cast("bigint"), F.col("page_count").cast("bigint") - 1)
    asked = open_books.select("book_id", "page_count", F.explode(
        F.when(F.size("pages") > 0, F.array_distinct("pages")).otherwise(every)).alias("page"))
    outside = asked.where((F.col("page") < 0) | (F.col("page") >= F.col("page_count"))).groupBy("book_id").agg(F.min("page").alias("page")).select(
        "book_id", F.lit("outside").alias("code"), "page")
    kept = asked.join(outside.select("book_id"), "book_id", "left_anti").select(*PAGE)
    stage = F.lit(default)
    if per_page is not None:
        kept = kept.join(per_page.groupBy(*PAGE).agg(F.max("stage").alias("stage")), list(PAGE), "left")
        stage = F.coalesce("stage", F.lit(default))
    phased = kept.select(*PAGE, tx.lookup(RERUN_ALIASES, stage).alias("phase"))
    bad = phased.where(F.col("phase").isNull()).groupBy("book_id").agg(F.min("page").alias("page")).select("book_id", F.lit("bad_stage").alias("code"), "page")
    return phased.join(bad.select("book_id"), "book_id", "left_anti"), none.unionByName(outside).unionByName(bad)


# archives --------------------------------------------------------------------------------

def archive_policy(members: DataFrame, limits: ArchiveLimits = ArchiveLimits()) -> DataFrame:
    """Limits an archive breaks: (book_id, code, name); `members`: book_id, name, size, is_dir."""
    plain = F.replace("name", F.lit("\\"), F.lit("/"))
    unsafe = ((plain == "") | plain.startswith("/") | F.contains(plain, F.lit("\u0000")) | F.array_contains(F.split(plain, "/"), ".."))
    image = tx.is_image_member(F.col("name"))
    preserved = ~F.col("is_dir") & ~tx.is_ignored_member(F.col("name")) & ~image
    rows = members.select("book_id", "name", "size", "is_dir", unsafe.alias("unsafe"), image.alias("image"), preserved.alias("preserved"))
    file = ~F.col("is_dir")
    single = F.array_compact(F.array(
        F.when(F.col("unsafe"), F.lit("unsafe_name")),
        F.when(~F.col("unsafe") & file & ((F.col("size") < 0) | (F.col("size") > limits.member_bytes)), F.lit("member_too_large")),
        F.when(~F.col("unsafe") & F.col("preserved") & (F.col("size") > limits.preserved_member_bytes), F.lit("preserved_too_large"))))
    own = rows.select("book_id", F.explode(single).alias("code"), "name")
    totals = rows.groupBy("book_id").agg(F.count(F.lit(1)).alias("members"), F.sum(F.when(file, F.col("size"))).alias("total"),
                                         F.count_if(F.col("image") & file).alias("images"), F.sum(F.when(F.col("preserved"), F.col("size"))).alias("kept"))
    book = totals.select("book_id", F.explode(F.array_compact(F.array(
        F.when(F.col("members") > limits.members, F.lit("too_many_members")), F.when(F.col("total") > limits.total_bytes, F.lit("total_too_large")),
        F.when(F.col("images") > limits.image_pages, F.lit("too_many_images")), F.when(F.col("kept") > limits.preserved_total_bytes, F.lit("preserved_total_too_large"))))).alias("code"),
        F.lit(None).cast("string").alias("name"))
    return own.unionByName(book)


def classify_members(members: DataFrame) -> DataFrame:
    ignored, image = tx.is_ignored_member(F.col("name")), tx.is_image_member(F.col("name"))
    kind = F.when(F.col("is_dir"), "directory").when(ignored, "ignored").when(image, "image").otherwise("preserved")
    return members.withColumn("kind", kind)


def pixel_policy(pages: DataFrame, page_limit: int = 120_000_000, book_limit: int = 5_000_000_000) -> DataFrame:
    pixels = F.col("width").cast("bigint") * F.col("height")
    own = pages.where(pixels > page_limit).select(*PAGE, F.lit("page_too_large").alias("code"))
    book = pages.groupBy("book_id").agg(F.sum(pixels).alias("total")).where(F.col("total") > book_limit).select(
        "book_id", F.lit(None).cast("bigint").alias("page"), F.lit("book_too_large").alias("code"))
    return own.unionByName(book)


def changed_inputs(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Current fingerprint against the stored one: same, changed, page_count or adopted (none stored)."""
    old = stored.select("book_id", F.struct("sha256", "size", "page_count").alias("o"))
    state = (F.when(F.col("o").isNull(), "adopted").when((F.col("sha256") != F.col("o.sha256")) | (F.col("size") != F.col("o.size")), "changed")
             .when(F.col("o.page_count") != F.col("page_count"), "page_count").otherwise("same"))
    return current.join(old, "book_id", "left").select("book_id", state.alias("state"))


# job states ------------------------------------------------------------------------------

def job_flags(jobs: DataFrame) -> DataFrame:
    """What can be done with a job. `jobs`: job_id, status, active, has_input, review_checkpoint,
    original_pages, final_pages."""
    s = F.coalesce("status", F.lit("unknown"))
    idle = ~F.col("active")
    review = (s == "paused") & F.col("review_checkpoint") & idle
    done = s == "complete"
    return jobs.select(
        *JOB, ((s.isin("failed", "cancelled") | ((s == "paused") & idle)) & F.col("has_input")).alias("can_restart"),
        (s.isin("running", "paused", "terminating") & F.col("active")).alias("can_terminate"), (s.isin(*TERMINAL) & idle).alias("can_delete"),
        (~s.isin("queued", "running") & idle).alias("can_rename"), done.alias("can_rerun"), (done | review).alias("can_edit"),
        (done & (F.col("final_pages") > 0)).alias("can_view"), (F.col("original_pages") > 0).alias("can_view_original"),
        (idle & s.isin("queued", "failed", "cancelled", "paused", "complete")).alias("can_change_options"))


def job_summary(jobs: DataFrame, fields: Sequence[str], category: str | None = None, status: str | None = None) -> DataFrame:
    kept = jobs if category is None else jobs.where(F.col("category") == category)
    kept = kept if status is None else kept.where(F.col("status") == status)
    return kept.select(*fields)


def title_choice(jobs: DataFrame) -> DataFrame:
    """Chosen and alternate title. `jobs`: job_id, source_title, translated_title, mode, alt_in_notes."""
    mode = F.when(F.col("mode") == "translated", "translated").otherwise("original")
    source, translated = F.nullif(tx.strip(F.col("source_title")), F.lit("")), F.nullif(tx.strip(F.col("translated_title")), F.lit(""))
    chosen = F.when((mode == "translated") & translated.isNotNull(), translated).otherwise(source)
    alt = F.when(F.col("alt_in_notes"), F.when(mode == "translated", source).otherwise(translated))
    return jobs.select(*JOB, F.when(source.isNotNull(), chosen).alias("title"), F.when(source.isNotNull(), alt).alias("alternate"))


def apply_settings(jobs: DataFrame, categories: DataFrame, fields: Sequence[str], defaults: dict[str, object]) -> DataFrame:
    """Settings of the category replace those of its queued jobs; unset ones fall back to defaults."""
    own = categories.select("category", *[F.col(f).alias(f"c_{f}") for f in fields])
    queued = F.col("status") == "queued"
    joined = jobs.join(own, "category", "left")
    return joined.select(*[c for c in jobs.columns if c not in fields],
                         *[F.when(queued, F.coalesce(F.col(f"c_{f}"), F.lit(defaults[f]))).otherwise(F.col(f)).alias(f) for f in fields])


def status_counts(jobs: DataFrame) -> DataFrame:
    status = F.coalesce(F.nullif("status", F.lit("")), F.lit("unknown"))
    return jobs.groupBy("category", status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def newest_first(jobs: DataFrame) -> DataFrame:
    """Jobs with their place in the category, the newest first; days are numbered apart and carried on.

    A crowded day is cut by the instant and the first characters of the id, a crowded instant by more of them.
    """
    created = F.col("created").cast("timestamp")
    none = F.lit(1 << 62)
    day = F.coalesce(-F.unix_date(created.cast("date")).cast("bigint"), none)
    instant = F.struct(F.coalesce(-F.unix_micros(created), none), F.substring("job_id", 1, 6))
    return split_row_number(jobs, ["category"], [F.col("created").desc_nulls_last(), F.col("job_id")],
                            [day, instant, F.substring("job_id", 1, 12)], "place", start=1)


def last_chapters_first(jobs: DataFrame) -> DataFrame:
    """Jobs of series with their place in the series, the last volume and chapter first; no volume comes after all volumes.

    `jobs`: series, job_id, volume and chapter (decimal texts, blank for none).
    """
    rows = jobs.withColumns({n: F.try_to_number(tx.strip(F.col(n)), F.lit("9999999999999999999D999999999999999999")) for n in ("volume", "chapter")})
    volume, chapter = F.coalesce("volume", F.lit(-1)), F.coalesce("chapter", F.lit(-1))
    order = [volume.desc(), chapter.desc(), F.col("job_id")]
    bucket = F.struct((-volume).alias("v"), (-F.floor(chapter / 256)).alias("c"))
    placed = split_row_number(rows, ["series"], order, bucket, "place", start=1)
    return placed.select("series", "job_id", "place")


# reports ---------------------------------------------------------------------------------

def trace_rollup(traces: DataFrame) -> DataFrame:
    """Per phase and model: attempts, failures, tokens and speed; reported tokens before counted ones."""
    tokens = F.coalesce("completion_tokens", "generated_tokens")
    rows = traces.groupBy("phase", "model").agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if("failed").alias("failures"), F.sum(tokens).cast("bigint").alias("tokens"),
        F.sum(F.col("elapsed_ms")).cast("bigint").alias("elapsed_ms"))
    return rows.withColumn("tokens_per_second", F.col("tokens") / F.greatest(F.col("elapsed_ms") / 1000.0, F.lit(0.001)))


def runtime_summary(runs: DataFrame, pages: DataFrame) -> DataFrame:
    """Elapsed seconds and seconds per page of each book; null without pages."""
    counts = pages.groupBy("book_id").agg(F.count(F.lit(1)).alias("pages"))
    elapsed = F.greatest(F.col("elapsed_seconds"), F.lit(0.001))
    return runs.join(counts, "book_id", "left").select("book_id", elapsed.alias("elapsed"), F.coalesce("pages", F.lit(0)).alias("pages"),
                                                       F.try_divide(elapsed, F.nullif("pages", F.lit(0))).alias("per_page"))


def _instants(at: str) -> list[Column]:
    """Levels of rows in the order of (at, seq): the day, the second, then the instant and a block of `seq`."""
    return [F.date_trunc("day", F.col(at)), F.date_trunc("second", F.col(at)), F.struct(at, position_block(F.col("seq")))]


def active_runtime(events: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Active milliseconds per job from start and stop events; further starts before a stop
    change nothing. `events`: job_id, at (timestamp), seq, kind; `base`: job_id, elapsed_ms.
    A running job also has `running_since`."""
    stop = (F.col("kind") == "stop").cast("bigint")
    numbered = split_running(events.where(F.col("kind").isin("start", "stop")), JOB, [F.col("at"), F.col("seq")],
                             _instants("at"), sums={"island": stop}, include_current=False)
    spans = numbered.groupBy(*JOB, "island").agg(
        F.min(F.when(F.col("kind") == "start", F.col("at"))).alias("begin"), F.max(F.when(F.col("kind") == "stop", F.col("at"))).alias("end"))
    length = F.greatest(F.lit(0), F.unix_micros(F.col("end").cast("timestamp")) - F.unix_micros(F.col("begin").cast("timestamp")))
    closed = F.when(F.col("begin").isNotNull() & F.col("end").isNotNull(), length).otherwise(0)
    out = spans.groupBy(*JOB).agg(F.sum(closed).alias("micros"), F.max(F.when(F.col("end").isNull(), F.col("begin"))).alias("running_since"))
    if base is None:
        return out.select(*JOB, F.col("micros").alias("elapsed_micros"), "running_since")
    return out.join(base, list(JOB), "left").select(
        *JOB, (F.col("micros") + F.coalesce("elapsed_ms", F.lit(0)) * 1000).alias("elapsed_micros"), "running_since")


def job_times(jobs: DataFrame, now: Column) -> DataFrame:
    """Age and elapsed seconds with their texts. `jobs`: job_id, created_at, updated_at, started_at,
    finished_at, active_started_at (ISO text), elapsed_seconds."""
    times = [tx.iso_timestamp(F.col(c)) for c in ("created_at", "updated_at", "started_at", "finished_at")]
    active, started = tx.iso_timestamp(F.col("active_started_at")), times[2]
    stored = F.greatest(F.lit(0.0), F.coalesce(F.col("elapsed_seconds").cast("double"), F.lit(0.0)))
    elapsed = stored + F.when(active.isNotNull(), F.greatest(F.lit(0.0), tx.seconds_between(now, active))).otherwise(F.lit(0.0))
    idle = (elapsed == 0) & active.isNull() & started.isNull()
    rows = jobs.select(*JOB, tx.seconds_between(now, F.coalesce(*times)).alias("age_seconds"), F.when(~idle, elapsed).alias("elapsed_seconds"))
    return rows.withColumns({"age": tx.age_text(F.col("age_seconds")), "elapsed": tx.duration_text(F.col("elapsed_seconds"))})


# logs ------------------------------------------------------------------------------------

def log_lines(logs: DataFrame) -> DataFrame:
    """Trimmed non-empty lines without live progress. `logs`: job_id, body (text of any size)."""
    return kept_lines(logs.select(*JOB, F.posexplode(tx.lines(F.col("body"))).alias("seq", "line")))


def kept_lines(lines: DataFrame) -> DataFrame:
    """The lines of `line`, trimmed, without empty ones and live progress."""
    rows = lines.withColumn("line", tx.strip(F.col("line")))
    return rows.where((F.col("line") != "") & ~F.rlike("line", F.lit(tx.LIVE_PROGRESS)))


def last_lines(lines: DataFrame, most: int = 1000) -> DataFrame:
    """The newest `most` lines of each job."""
    ranked = split_row_number(lines, JOB, [F.col("seq").desc()], -position_block(F.col("seq")), "__back")
    return ranked.where(F.col("__back") < most).drop("__back")


def progress(lines: DataFrame) -> DataFrame:
    """Phase, page and resume target of every line that reports progress."""
    read = staged(lines.select(*JOB, "seq", "line"), phase=tx.progress_phase(F.col("line")))
    read = staged(read.where(F.col("phase").isNotNull()), page=tx.progress_page(F.col("line"))).drop("line")
    return staged(read, target=tx.progress_target(F.col("phase"), F.col("page")))


def latest_progress(lines: DataFrame, terminated: DataFrame | None = None) -> DataFrame:
    """Current phase, page and resume target per job; jobs waiting for termination are left alone."""
    seen = progress(lines)
    if terminated is not None:
        seen = seen.join(terminated.select(*JOB).distinct(), list(JOB), "left_anti")
    last = seen.groupBy(*JOB).agg(F.max_by(F.struct("phase", "page"), "seq").alias("x"),
                                  F.max_by("target", F.when(F.col("target").isNotNull(), F.col("seq"))).alias("target"))
    return last.select(*JOB, "x.phase", "x.page", F.col("target.phase").alias("resume_from"), F.col("target.page").alias("resume_page"))


def restart_target(jobs: DataFrame, lines: DataFrame) -> DataFrame:
    """Where to restart a job: stored target, last phase, current phase, else the log.

    `jobs`: job_id, last_resume_from, last_resume_page, last_phase, last_page, phase, page.
    """
    logged = progress(lines).where(F.col("target").isNotNull()).groupBy(*JOB).agg(F.max_by("target", "seq").alias("from_log"))
    target = F.coalesce(tx.resume_target(F.col("last_resume_from"), F.col("last_resume_page")),
                        tx.progress_target(F.col("last_phase"), F.col("last_page")), tx.progress_target(F.col("phase"), F.col("page")), F.col("from_log"))
    return jobs.join(logged, list(JOB), "left").withColumn("t", target).select(*JOB, F.col("t.phase").alias("resume_from"), F.col("t.page").alias("resume_page"))


# limiter ---------------------------------------------------------------------------------

def failure_limiter(attempts: DataFrame, limit: int = 5, window_seconds: int = 60) -> DataFrame:
    """Failures still counted at each attempt and the seconds to wait, 0 below the limit.

    A success clears the failures before it, and a failure counts for less than the window.
    `attempts`: client, seq, at (timestamp), ok. Clients are cut into spans of one window;
    each span also holds the one before it, so no task needs a client's whole history.
    """
    span = window_seconds * 1_000_000
    rows = attempts.withColumn("us", F.unix_micros(F.col("at").cast("timestamp"))).withColumn("part", F.floor(F.col("us") / span))
    cleared = split_running(rows, ("client",), [F.col("us"), F.col("seq")], _instants("at"), sums={"cleared": F.col("ok").cast("bigint")})
    halo = cleared.withColumn("p", F.explode(F.array(F.col("part"), F.col("part") + 1)))
    failed = ~F.col("ok")
    # attempts of the same time count in the order of seq: the later ones of the range are taken off again
    part = Window.partitionBy("client", "cleared", "p")
    recent, same = part.orderBy("us").rangeBetween(-(span - 1), 0), Window.partitionBy("client", "cleared", "p", "us")
    after = F.count_if(failed).over(same) - F.count_if(failed).over(same.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    counted = (halo.withColumn("failures", F.count_if(failed).over(recent) - after)
               .withColumn("oldest", F.when(F.col("failures") > 0, F.min(F.when(failed, F.col("us"))).over(recent))).where("p = part"))
    wait = F.greatest(F.lit(1).cast("bigint"), F.bround(F.lit(float(window_seconds)) - (F.col("us") - F.col("oldest")) / 1e6, 0).cast("bigint"))
    return counted.select("client", "seq", F.col("failures"), F.when(F.col("failures") >= limit, wait).otherwise(F.lit(0)).alias("retry_after"))


def token_meter(chunks: DataFrame) -> DataFrame:
    """Chunks per call; reported usage overrides the count. `chunks`: call, seq, kind, usage (nullable)."""
    reasoning, answer = F.count_if(F.col("kind") == "reasoning"), F.count_if(F.col("kind") == "answer")
    usage = F.max_by("usage", F.when(F.col("usage").isNotNull(), F.col("seq")))
    return chunks.groupBy("call").agg(reasoning.alias("reasoning_chunks"), answer.alias("answer_chunks"), F.coalesce(usage, reasoning + answer).alias("tokens"))
