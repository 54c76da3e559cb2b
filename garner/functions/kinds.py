"""Kinds of chats and messages from the source apps' raw numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Message and media kinds by raw number.
MESSAGE_KINDS = {0: "text", 1: "image", 2: "video", 3: "audio", 4: "location", 5: "contact", 6: "system", 7: "link", 8: "document", 10: "group_event", 11: "gif", 14: "reaction", 15: "sticker", 59: "status_update"}
MEDIA_KINDS = {1: "image", 2: "video", 3: "audio", 7: "link", 8: "document", 11: "gif", 15: "sticker"}
# Forms of a chat's address with the kind each means, and the raw number of status chats.
CHAT_FORMS = (("%@g.us", "group"), ("%@newsletter%", "newsletter"), ("%@status%", "status"), ("status@broadcast", "status"))
STATUS_CHAT = 3


def _named(raw: Column, names: dict[int, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, raw.cast("int")), F.lit(""))


def message_kind(raw: Column) -> Column:
    """Kind of a message; '' for unknown numbers and null."""
    return _named(raw, MESSAGE_KINDS)


def media_kind(raw: Column) -> Column:
    """Kind of a message's media; '' for messages without media, unknown numbers and null."""
    return _named(raw, MEDIA_KINDS)


def chat_kind(jid: Column, raw: Column) -> Column:
    """Group, newsletter, status or direct chat, by the form of its address, then by its raw number."""
    forms = F.lit(None).cast("string")
    for pattern, kind in CHAT_FORMS:
        forms = F.coalesce(forms, F.when(jid.like(pattern), F.lit(kind)))
    return F.coalesce(forms, F.when(raw == STATUS_CHAT, F.lit("status")), F.lit("dm"))
