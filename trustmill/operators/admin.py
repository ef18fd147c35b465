"""What administrators do: approve, reject, recheck, switch sources, and the chat commands for it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trustmill.operators.transitions import apply_feedback
from trustmill.session import dealt

OPEN = ("NEEDS_REVIEW", "SUSPICIOUS", "DISCOVERED")
#: Labels of feedback and the texts of replies.
LABELS = ("FALSE_POSITIVE", "FALSE_LINK", "WRONG_EVENT", "WRONG_DATE", "DUPLICATE", "LEGITIMATE")
HELP = "Commands:\n/review\n/approve EVENT_ID\n/reject EVENT_ID\n/recheck EVENT_ID\n/event EVENT_ID\n/feedback EVENT_ID LABEL\n/source-status\n/stats"
USAGE = {"/approve": "Usage: /approve EVENT_ID", "/reject": "Usage: /reject EVENT_ID", "/recheck": "Usage: /recheck EVENT_ID", "/event": "Usage: /event EVENT_ID", "/feedback": "Usage: /feedback EVENT_ID LABEL"}


def decide(events: DataFrame, reviews: DataFrame, decisions: DataFrame, now: Column) -> dict[str, DataFrame]:
    """events, reviews and results after decisions taken one after another.

    decisions: seq, event_id, action (approve, reject, recheck), reason (of a rejection; null: REJECTED_BY_ADMIN). Only
    events that wait for it can be approved, as they stand when it is their turn; decisions on others and on unknown
    events change nothing (done is false). A rejection or approval resolves the open reviews of its event, the first of
    several; a recheck sends it back to verification.
    """
    in_turn = Window.partitionBy("event_id").orderBy("seq", "action")
    known = decisions.select("seq", "event_id", "action", "reason").join(events.select("event_id", F.col("status").alias("_status")), "event_id", "left").withColumn("_before", F.lag("action").over(in_turn))
    # after an approval or rejection an event does not wait any more, after a recheck it does
    waits = F.when(F.col("_before").isNull(), F.col("_status").isin(*OPEN)).otherwise(F.col("_before") == "recheck")
    done = F.col("_status").isNotNull() & ((F.col("action") != "approve") | waits)
    told = known.withColumn("done", F.coalesce(done, F.lit(False)))
    turn = F.struct("seq", "action")
    closing = F.col("action").isin("approve", "reject")
    resolution = F.when(F.col("action") == "approve", "APPROVED").otherwise(F.coalesce("reason", F.lit("REJECTED_BY_ADMIN")))
    hit = told.where("done").groupBy("event_id").agg(F.max_by("action", turn).alias("_action"), F.bool_or(F.col("action") == "recheck").alias("_rechecked"), F.min_by(F.when(closing, resolution), F.when(closing, turn)).alias("_resolution"))
    action, acted, rechecked = F.col("_action"), F.col("_action").isNotNull(), F.coalesce("_rechecked", F.lit(False))
    after = F.when(action == "approve", "VERIFIED").when(action == "reject", "REJECTED").when(action == "recheck", "DISCOVERED").otherwise(F.col("status"))
    changed = {"status": after, "last_seen": F.when(acted, now).otherwise(F.col("last_seen")), "verification_decision": F.when(~rechecked, F.col("verification_decision")), "verification_score": F.when(rechecked, 0).otherwise(F.col("verification_score"))}
    closed = F.col("_resolution").isNotNull() & ~F.col("resolved")
    return {
        "events": events.join(hit, "event_id", "left").withColumns(changed).select(*events.columns),
        "reviews": reviews.join(hit, "event_id", "left").withColumns({"resolution": F.when(closed, F.col("_resolution")).otherwise(F.col("resolution")), "resolved": F.col("resolved") | closed}).select(*reviews.columns),
        "results": told.select("seq", "event_id", "action", "done"),
    }


def record_feedback(events: DataFrame, event_sources: DataFrame, reviews: DataFrame, sources: DataFrame, feedback: DataFrame) -> dict[str, DataFrame]:
    """reviews, sources and results after feedback on events. feedback: seq, event_id, label; sources: source_id,
    trust_score. Feedback on unknown events changes nothing; the first on an event resolves its open reviews by its label,
    and each counts for every source of the event (see `apply_feedback`)."""
    told = feedback.select("seq", "event_id", "label").join(events.select("event_id").distinct().withColumn("done", F.lit(True)), "event_id", "left").withColumn("done", F.coalesce("done", F.lit(False)))
    hit = told.where("done")
    steps = hit.join(event_sources.select("event_id", "source_id").distinct(), "event_id").select("source_id", "seq", "label")
    first = hit.groupBy("event_id").agg(F.min_by("label", "seq").alias("_label"))
    closed = F.col("_label").isNotNull() & ~F.col("resolved")
    return {
        "reviews": reviews.join(first, "event_id", "left").withColumns({"resolution": F.when(closed, F.col("_label")).otherwise(F.col("resolution")), "resolved": F.col("resolved") | closed}).select(*reviews.columns),
        "sources": apply_feedback(sources, steps),
        "results": told.select("seq", "event_id", "label", "done"),
    }


def set_enabled(registry: DataFrame, switches: DataFrame) -> DataFrame:
    """The registry with some sources switched. switches: source_id, on."""
    return registry.join(switches.select("source_id", "on"), "source_id", "left").withColumn("enabled", F.coalesce("on", "enabled")).select(*registry.columns)


def commands(updates: DataFrame, admins: list[str]) -> DataFrame:
    """updates (chat_id, text) of allowed chats with command, event_id, label and the reply that needs no lookup (null
    where one is needed). Other chats get no row and so no answer."""
    words = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", ""), r"\s+")
    parts = updates.where(F.col("chat_id").cast("string").isin(*admins)).select("*", words.alias("_words")).select("*", *(F.nullif(F.get("_words", F.lit(k)), F.lit("")).alias(n) for k, n in enumerate(("command", "event_id", "label")))).drop("_words")
    command, reply = F.coalesce("command", F.lit("")), F.lit(None).cast("string")
    for name, text in USAGE.items():
        reply = F.when((command == name) & F.col("event_id").isNull(), text).otherwise(reply)
    reply = F.when((command == "/feedback") & F.col("label").isNull(), USAGE["/feedback"]).when((command == "/feedback") & F.col("event_id").isNotNull() & ~F.col("label").isin(*LABELS), f"LABEL must be one of: {', '.join(LABELS)}").otherwise(reply)
    reply = F.when(command == "/help", HELP).when(~command.isin(*USAGE, "/help", "/review", "/source-status", "/stats"), "Unknown command. Send /help.").otherwise(reply)
    return parts.withColumn("reply", reply)


def event_details(events: DataFrame, event_sources: DataFrame, evidence: DataFrame, flags: DataFrame) -> DataFrame:
    """events with sources, evidence and flags, each an array of what is known (empty if nothing), sorted."""
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>"))
    children = {
        "sources": (event_sources, ["source_id", "source_url", "observed_at"]), "evidence": (evidence, ["evidence_type", "evidence_text", "supports_claim"]), "flags": (flags, ["flag_type", "severity", "resolved"]),
    }
    out = events
    for name, (rows, columns) in children.items():
        kind = rows.select(F.struct(*columns).alias("x")).schema["x"].dataType.simpleString()
        grouped = rows.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
        out = out.join(grouped, "event_id", "left").withColumn(name, none(F.col(name), kind))
    return out


#: Open reviews that a chat is shown, and signs of their reasons.
REVIEWS, REASON_SIGNS = 10, 80


def reports(events: DataFrame, reviews: DataFrame, registry: DataFrame, dead_letters: DataFrame, notifications: DataFrame) -> DataFrame:
    """command and text of the three replies that show the state as a whole: /review, /source-status and /stats.

    The registry's rows are as many as there are sources to read, and the text has a line for each."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    lines = lambda order: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, "line"))), lambda s: s["line"]), "\n")
    line = F.concat(F.col("review_id").cast("string"), F.lit(" "), F.col("event_id").cast("string"), F.lit(" ["), shown("score"), F.lit("] "), shown("title"), F.lit(" \u2014 "), F.left("reason", F.lit(REASON_SIGNS)))
    waiting = reviews.where(~F.col("resolved")).join(events.select("event_id", "title"), "event_id").orderBy(F.desc("created_at"), "review_id").limit(REVIEWS)
    waiting = waiting.select((-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("late"), "review_id", line.alias("line")).agg(lines(("late", "review_id")).alias("text"))
    status = F.concat("source_id", F.lit(" trust="), F.col("trust_score").cast("string"), F.when(F.col("enabled").cast("boolean"), " on").otherwise(" off"), F.lit(" last="), F.coalesce("last_status", F.lit("-")))
    sources = registry.select("source_id", status.alias("line")).agg(lines(("source_id",)).alias("text"))
    counted = lambda c, name, part: events.groupBy(c.alias(name)).agg(F.count(F.lit(1)).alias("c")).agg(F.to_json(F.sort_array(F.collect_list(F.struct(name, "c")))).alias("text")).select(F.lit(part).alias("part"), "text")
    single = lambda df, part: df.agg(F.count(F.lit(1)).cast("string").alias("text")).select(F.lit(part).alias("part"), "text")
    # one row a part, put together in their order
    parts = [counted(F.col("status"), "status", "0events="), counted(F.coalesce("publishing_tier", F.lit("NONE")), "t", "1tiers="), single(reviews.where(~F.col("resolved")), "2reviewOpen="), single(dead_letters, "3dlq="), single(notifications.where("status = 'SENT'"), "4sent=")]
    stats = reduce(DataFrame.unionByName, parts).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "text"))), lambda x: F.concat(F.substring(x["part"], 2, 99), x["text"])), " ").alias("text"))
    named = lambda df, command, empty: df.select(F.lit(command).alias("command"), F.coalesce(F.nullif("text", F.lit("")), F.lit(empty)).alias("text"))
    return named(waiting, "/review", "Review queue is empty.").unionByName(named(sources, "/source-status", "No sources.")).unionByName(named(stats, "/stats", ""))


def answered(told: DataFrame, results: DataFrame, events: DataFrame, shown: DataFrame | None = None) -> DataFrame:
    """The rows of `commands` with their replies, after `decide`. told and results have seq, the number of the update;
    results: seq, done; shown: the texts of `reports`."""
    about = events.select("event_id", F.lit(True).alias("_known"), "title", "status", "verification_score", "publishing_tier", "registration_url", "registration_unverified_note")
    rows = told.join(about, "event_id", "left").join(results.where("done").select("seq", F.lit(True).alias("_done")), "seq", "left")
    rows = rows.join(F.broadcast(shown.select("command", F.col("text").alias("_shown"))), "command", "left") if shown is not None else rows.withColumn("_shown", F.lit(None).cast("string"))
    known, acted, c, e = F.coalesce("_known", F.lit(False)), F.coalesce("_done", F.lit(False)), F.col("command"), F.col("event_id")
    unknown = F.concat(F.lit("Unknown event "), e, F.lit("."))
    about = F.concat(F.col("title"), F.lit("\nstatus="), "status", F.lit(" score="), "verification_score", F.lit(" tier="), F.coalesce("publishing_tier", F.lit("?")), F.lit("\nreg="), F.coalesce("registration_url", "registration_unverified_note", F.lit("none")))
    reply = (
        F.when(F.col("reply").isNotNull(), F.col("reply"))
        .when(c == "/approve", F.when(acted, F.concat(F.lit("Approved "), e, F.lit("."))).otherwise(F.concat(F.lit("Nothing to approve for "), e, F.lit("."))))
        .when(c == "/reject", F.when(acted, F.concat(F.lit("Rejected "), e, F.lit("."))).otherwise(unknown))
        .when(c == "/recheck", F.when(acted, F.concat(e, F.lit(" queued for re-verification."))).otherwise(unknown))
        .when(c == "/event", F.when(known, about).otherwise(unknown))
        .when(c == "/feedback", F.when(known, F.concat(F.lit("Feedback "), "label", F.lit(" recorded for "), e, F.lit("."))).otherwise(unknown))
        .otherwise(F.col("_shown"))
    )
    return rows.select(*(x for x in told.columns if x != "reply"), reply.alias("reply"))


#: The tables' keys, and which column refers to which table and what becomes of it when a row there goes.
KEYS = {"events": "event_id", "event_links": "link_id"}
REFERENCES = (
    ("event_sources", "event_id", "events", "CASCADE"), ("event_changes", "event_id", "events", "CASCADE"), ("event_links", "event_id", "events", "CASCADE"), ("link_checks", "link_id", "event_links", "CASCADE"),
    ("verification_evidence", "event_id", "events", "CASCADE"), ("notifications", "event_id", "events", "CASCADE"), ("review_queue", "event_id", "events", "CASCADE"), ("security_flags", "event_id", "events", "CASCADE"),
    ("security_flags", "link_id", "event_links", "SET NULL"),
)


def delete_rows(tables: dict[str, DataFrame], name: str, gone: DataFrame) -> dict[str, DataFrame]:
    """The tables without the rows of one whose keys are in `gone`, and without what refers to these, table by table;
    references that outlive their row become null. Rows whose reference is null are kept beside the joins, as a null key
    would bring them all to one task."""
    out, waiting = dict(tables), [(name, KEYS[name], gone.select(KEYS[name]).distinct())]
    counted: dict[str, int] = {}

    def sides(table: str, keys: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
        if table not in counted:
            counted[table] = tables[table].count()
        return dealt(out[table].where(F.col(column).isNotNull()), keys, column, counted[table])

    while waiting:
        table, column, keys = waiting.pop(0)
        (named, keys), unnamed = sides(table, keys, column), out[table].where(F.col(column).isNull())
        removed = named.join(keys, column, "left_semi")
        out[table] = named.join(keys, column, "left_anti").select(*tables[table].columns).unionByName(unnamed)
        for child, reference, parent, then in REFERENCES:
            if parent != table or child not in out:
                continue
            lost = removed.select(F.col(KEYS[table]).alias(reference)).distinct()
            if then == "CASCADE":
                waiting.append((child, reference, lost))
            else:
                (named, lost), unnamed = sides(child, lost.withColumn("_lost", F.lit(True)), reference), out[child].where(F.col(reference).isNull())
                marked = named.join(lost, reference, "left")
                out[child] = marked.withColumn(reference, F.when(F.col("_lost").isNull(), F.col(reference))).select(*tables[child].columns).unionByName(unnamed)
    return out


def reset(tables: dict[str, DataFrame], production: bool) -> dict[str, DataFrame]:
    """For development: events with all that refers to them, runs and dead letters go, the registry stays as if it never
    ran."""
    if production:
        raise PermissionError("refusing to reset in production")
    out = delete_rows(tables, "events", tables["events"]) if "events" in tables else dict(tables)
    out |= {name: out[name].limit(0) for name in ("source_runs", "dead_letter_queue") if name in out}
    if "source_registry" in out:
        out["source_registry"] = out["source_registry"].withColumns({"last_run": F.lit(None).cast("timestamp"), "last_status": F.lit(None).cast("string")})
    return out
