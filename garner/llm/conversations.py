"""Ordered conversations from message rows.

Messages come as (source, conversation, message, speaker, at, ...). Reply graphs are sorted by
Kahn's algorithm with ties broken by time: a message may come once its parent has come. Where
every reply is later than its parent, in (time, key), Kahn's order is the order of time itself,
so only conversations with a reply before its parent need rounds of removal; what remains after
the last round lies on a cycle or behind one, and breaks the conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garner.operators.segments import blocks, running
from garner.session import cut

#: Only white space or invisible characters.
BLANK = r"^[\p{IsWhite_Space}​￼]*$"
REPLY_MARK = r"(?i)^\s*(?:re|aw|sv|antw)\s*(?:\[\s*\d+\s*\])?\s*:"


def has_text(column: str):
    """Whether a text shows anything; null shows nothing."""
    return F.col(column).isNotNull() & ~F.col(column).rlike(BLANK)


def reply_faults(messages: DataFrame) -> DataFrame:
    """Conversations whose reply graph is broken: a parent outside the conversation, or a cycle.

    ``messages``: conversation, message, parent, at; one row per message. A null parent is no
    reply; a null time sorts first. Returns distinct conversations. A message that answers itself
    is a cycle. An empty input gives an empty result.
    """
    nodes = cut(messages.select("conversation", "message", "parent", "at"))
    parents = nodes.select(F.col("conversation").alias("p_conversation"), F.col("message").alias("p_message"), F.col("at").alias("p_at"))
    replies = nodes.where("parent is not null").join(
        parents, (F.col("conversation") == F.col("p_conversation")) & (F.col("parent") == F.col("p_message")), "left"
    )
    orphan = replies.where("p_message is null").select("conversation")
    backward = replies.where("p_message is not null and struct(at, message) <= struct(p_at, p_message)").select("conversation").distinct()
    backward = cut(backward)
    if backward.isEmpty():
        return orphan.distinct()
    loops = kahn_leftover(nodes.join(backward, "conversation", "left_semi"))
    return orphan.unionByName(loops.select("conversation")).distinct()


def kahn_leftover(nodes: DataFrame) -> DataFrame:
    """Messages that Kahn's removal never reaches: those on a cycle or behind one.

    Every message has at most one parent, so round k removes all messages whose chain of parents
    ends within 2^k steps: a link to the parent becomes one to the grandparent's ... and a chain
    that ends is removed whole. Every round removes something as long as a chain that ends is left,
    so a round that removes nothing leaves only links on a cycle or behind one. The number of
    rounds is the logarithm of the longest chain.
    """
    keys = ["conversation", "message"]
    ids = nodes.select(*keys)
    link = nodes.where("parent is not null").select(*keys, F.col("parent").alias("to"))
    # A parent outside the conversation ends the chain.
    link = cut(link.join(ids.withColumnRenamed("message", "to"), ["conversation", "to"], "left_semi").select(*keys, "to"))
    left, before = link.count(), None
    while left and left != before:
        onward = link.select("conversation", F.col("message").alias("to"), F.col("to").alias("further"))
        link = cut(link.join(onward, ["conversation", "to"]).select(*keys, F.col("further").alias("to")))
        left, before = link.count(), left
    return link.select(*keys)


def kahn_order(messages: DataFrame) -> DataFrame:
    """``messages`` with ``order``, by which they sort as Kahn's algorithm puts them out, the earliest (at, message) that may come next first.

    A message that waits for later ones comes right behind them, so its place follows from the
    times on its chain of parents: ``order`` holds those (at, message) from the root down that no
    nearer one on the chain exceeds, itself at the end, and compares place by place. Chains are put
    together by doubling, only in conversations with a reply before its parent; elsewhere ``order``
    is the message's own time. Messages on a cycle or behind one are left out. A parent outside the
    conversation ends the chain; a null time sorts first.
    """
    keys = ["conversation", "message"]
    own = F.struct("at", "message")
    nodes = cut(messages.withColumn("order", F.array(own)))
    parents = nodes.select("conversation", F.col("message").alias("parent"), F.col("at").alias("p_at"))
    linked = nodes.where("parent is not null").select(*keys, "at", "parent").join(parents, ["conversation", "parent"])
    backward = cut(linked.where("struct(at, message) <= struct(p_at, parent)").select("conversation").distinct())
    if backward.isEmpty():
        return nodes
    held = nodes.join(backward, "conversation", "left_semi")
    inside = linked.join(backward, "conversation", "left_semi").select(*keys, F.col("parent").alias("to"))
    chains = cut(held.select(*keys, "order").join(inside, keys, "left"))
    left, before = chains.where("to is not null").count(), None
    while left and left != before:
        upper = chains.select("conversation", F.col("message").alias("to"), F.col("order").alias("above"), F.col("to").alias("further"))
        joined = chains.join(upper, ["conversation", "to"], "left")
        order = F.when(F.col("above").isNull(), F.col("order")).otherwise(F.concat(F.filter("above", lambda x: x > F.col("order")[0]), "order"))
        chains = cut(joined.select(*keys, order.alias("order"), F.col("further").alias("to")))
        left, before = chains.where("to is not null").count(), left
    done = held.drop("order").join(chains.where("to is null").select(*keys, "order"), keys)
    return nodes.join(backward, "conversation", "left_anti").unionByName(done.select(nodes.columns))


def keep_whole(messages: DataFrame, faults: DataFrame | None = None) -> DataFrame:
    """Messages of conversations with at least two speakers and no fault.

    ``messages``: source, conversation, message, speaker, at, broken (a flag on any message that
    breaks its conversation). ``faults``: source, conversation of further broken conversations.
    Rows with a null conversation belong to none and are left out.
    """
    group = ["source", "conversation"]
    facts = messages.groupBy(*group).agg(
        F.min("speaker").alias("low"), F.max("speaker").alias("high"), F.max(F.coalesce("broken", F.lit(False))).alias("bad")
    )
    kept = facts.where("low <> high and not bad").select(*group)
    if faults is not None:
        kept = kept.join(faults.select(*group), group, "left_anti")
    return messages.join(kept, group, "left_semi")


def number_turns(messages: DataFrame, order: list[str]) -> DataFrame:
    """``turn_no`` from 1 in ``order`` within each conversation; a conversation may hold any share of the rows."""
    group = ["source", "conversation"]
    return running(blocks(messages, group, order), group, order, name="turn_no")
