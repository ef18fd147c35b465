"""Channel payloads as columns, answers of channels, and sending from tasks."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIMEOUT_S = 15


def telegram_payload(chat: Column, text: Column) -> Column:
    return F.to_json(F.struct(chat.alias("chat_id"), F.left(text, F.lit(4000)).alias("text"), F.lit(False).alias("disable_web_page_preview")))


def discord_payload(text: Column, title: Column, description: Column, fields: Column, buttons: Column) -> Column:
    """fields: array of struct(name, value, inline); buttons: array of struct(label, url)."""
    shown = lambda c, n: F.left(F.when(F.coalesce(c, F.lit("")) == "", F.lit("—")).otherwise(c), F.lit(n))
    tidy = F.transform(fields, lambda f: F.struct(shown(f["name"], 256).alias("name"), shown(f["value"], 1024).alias("value"), f["inline"].alias("inline")))
    row = F.transform(F.slice(buttons, 1, 5), lambda b: F.struct(F.lit(2).alias("type"), F.lit(5).alias("style"), F.left(b["label"], F.lit(80)).alias("label"), b["url"].alias("url")))
    embed = F.struct(F.left(title, F.lit(256)).alias("title"), F.left(description, F.lit(2000)).alias("description"), tidy.alias("fields"))
    components = F.when(F.size(buttons) > 0, F.array(F.struct(F.lit(1).alias("type"), row.alias("components"))))
    return F.to_json(F.struct(F.left(text, F.lit(1500)).alias("content"), F.array(embed).alias("embeds"), components.alias("components")))


def whatsapp_payload(to: Column, text: Column, title: Column | None = None, buttons: Column | None = None, template: str | None = None, language: str = "en") -> Column:
    """A text message, or with the name of an approved template its three parameters: the title, the buttons (array of
    struct(label, url)) and how to unsubscribe."""
    head = F.lit("whatsapp").alias("messaging_product"), F.lit("individual").alias("recipient_type"), to.alias("to")
    if template is None:
        return F.to_json(F.struct(*head, F.lit("text").alias("type"), F.struct(F.lit(True).alias("preview_url"), F.left(text, F.lit(4000)).alias("body")).alias("text")))
    links = F.array_join(F.transform(F.coalesce(buttons, F.array().cast("array<struct<label:string,url:string>>")), lambda b: F.concat(b["label"], F.lit(": "), b["url"])), "\n")
    said = F.coalesce(F.nullif(F.left(links, F.lit(500)), F.lit("")), F.lit("See official event page"))
    parameters = F.array(*(F.struct(F.lit("text").alias("type"), p.alias("text")) for p in (F.left(title, F.lit(200)), said, F.lit("Reply STOP to unsubscribe"))))
    body = F.array(F.struct(F.lit("body").alias("type"), parameters.alias("parameters")))
    told = F.struct(F.lit(template).alias("name"), F.struct(F.lit(language).alias("code")).alias("language"), body.alias("components"))
    return F.to_json(F.struct(*head, F.lit("template").alias("type"), told.alias("template")))


#: Seconds that a channel wants to be left alone after a 429 when its answer does not say.
WAITS = {"WHATSAPP": 30}


def answer(status: Column, body: Column, channel: str | None = None) -> Column:
    """struct(ok, retryable, retry_after_s, error) of a channel's answer. No answer at all can be tried again."""
    ok = F.coalesce(status.between(200, 299), F.lit(False))
    retry = F.coalesce((status == 429) | (status >= 500), F.lit(True))
    asked = F.coalesce(F.get_json_object(body, "$.parameters.retry_after").try_cast("int"), F.get_json_object(body, "$.retry_after").try_cast("double").try_cast("int"), F.lit(WAITS.get(channel or "", 0)))
    said = F.left(F.coalesce(body, F.lit("NO_ANSWER")), F.lit(200))
    error = F.when(status.isNull(), F.when(said.rlike("(?i)timed out|timeout"), "TIMEOUT").otherwise("NETWORK_ERROR")).otherwise(F.concat(F.lit(f"{channel}_HTTP_"), status.cast("string"), F.lit(":"), said)) if channel else said
    return F.struct(ok.alias("ok"), (~ok & retry).alias("retryable"), F.when(F.coalesce(status == 429, F.lit(False)), asked).otherwise(0).alias("retry_after_s"), F.when(~ok, error).alias("error"))


def post(url: str, payload: str) -> tuple[int | None, str]:
    request = urllib.request.Request(url, data=payload.encode(), headers={"Content-Type": "application/json"}, method="POST")
    try:
        with urllib.request.urlopen(request, timeout=TIMEOUT_S) as reply:
            return reply.status, reply.read(2000).decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, e.read(2000).decode("utf-8", "replace")
    except OSError as e:
        return None, str(e)


def send(messages: DataFrame, sender: Callable[[str, str], tuple[int | None, str]] = post) -> DataFrame:
    """notification_id, ok, retryable, error, retry_after_s after posting each message once. messages: notification_id, url,
    payload.

    For use in foreachBatch: the result is written before the queue's next state is published, and the queue is the
    guard against sending again.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            results = [sender(u, p) for u, p in zip(batch["url"], batch["payload"], strict=True)]
            yield pd.DataFrame({"notification_id": batch["notification_id"], "status": pd.array([r[0] for r in results], dtype="Int32"), "body": [r[1] for r in results]})

    sent = messages.select("notification_id", "url", "payload").mapInPandas(run, "notification_id long, status int, body string")
    return sent.select("notification_id", answer(F.col("status"), F.col("body")).alias("a")).select("notification_id", "a.ok", "a.retryable", "a.error", "a.retry_after_s")


def dead_letters(failed: DataFrame, queue: str, error: Column) -> DataFrame:
    return failed.select(F.lit(queue).alias("queue"), F.to_json(F.struct(*failed.columns)).alias("payload"), error.alias("error"), F.lit(1).alias("attempts"))


def report_line(event: Column, score: Column, source: Column, registration: Column, link: Column, reason: Column, duplicate: Column | None = None) -> Column:
    """The lines of a dry run; duplicate: the reason for which the event would be another's duplicate."""
    lines = F.format_string("EVENT: %s\nSCORE: %s\nSOURCE: %s\nREG_URL: %s\nLINK: %s\nREASON: %s", event, score, source, F.coalesce(registration, F.lit("none")), link, reason)
    return lines if duplicate is None else F.concat(lines, F.lit("\nDUPECHECK: "), F.coalesce(duplicate, F.lit("INSUFFICIENT_EVIDENCE")))


def log_line(level: str, message: str, **fields: object) -> str:
    return json.dumps({"level": level, "message": message, **fields}, sort_keys=True, default=str)
