"""Filter states out of logs of actions, by aggregates only.

Every action changes the sets of picked and hidden signs (as ``FilterState`` does for
one viewer).  Replaying a log needs no order within a task: a sign is picked if its
last action that picks it came after its last one that drops it and no later than
any that empties the set.  So a log of any length is a few maxima per viewer and sign.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What the actions do to the sign they name: into and out of the picked and the hidden set.
PICK, DROP = ("select", "select_all", "filter_to"), ("deselect", "hide")
HIDE, SHOW = ("hide",), ("unhide", "select", "filter_to")


def _last(*actions: str) -> Column:
    return F.coalesce(F.max(F.when(F.col("action").isin(*actions), F.col("seq"))), F.lit(-1))


def replayed(actions: DataFrame) -> DataFrame:
    """user, mode, picked, hidden and facets after all of ``actions(user, seq, action, item)``.

    ``seq`` numbers a viewer's actions from 0.  ``filter_to`` picks one sign alone and
    goes to sign mode, ``mode`` sets the mode that ``item`` names, ``clear`` empties both
    sets, ``toggle`` flips a facet.  ``picked``, ``hidden`` and ``facets`` are sorted by
    code.  Actions without user, number or a known name, and those without the item
    that they need, change nothing; a viewer with any action has a row.
    """
    known = actions.where("user is not null and seq is not null").select("user", "seq", "action", "item")
    mode = F.max_by(F.when(F.col("action") == "filter_to", "sign-id").otherwise(F.col("item")), F.when((F.col("action") == "filter_to") | ((F.col("action") == "mode") & F.col("item").isNotNull()), F.col("seq")))
    resets = F.coalesce(F.max(F.when((F.col("action") == "clear") | ((F.col("action") == "filter_to") & F.col("item").isNotNull()), F.col("seq"))), F.lit(-1))
    viewers = known.groupBy("user").agg(F.coalesce(mode, F.lit("category")).alias("mode"), resets.alias("_reset"), _last("clear").alias("_clear"))
    ends = {"_pick": _last(*PICK), "_drop": _last(*DROP), "_hide": _last(*HIDE), "_show": _last(*SHOW), "_flips": F.count_if(F.col("action") == "toggle")}
    items = known.where("item is not null").groupBy("user", "item").agg(*(c.alias(name) for name, c in ends.items())).join(viewers, "user")
    sets = {
        "picked": (F.col("_pick") > F.col("_drop")) & (F.col("_pick") >= F.col("_reset")) & (F.col("_pick") >= 0),
        "hidden": (F.col("_hide") > F.col("_show")) & (F.col("_hide") > F.col("_clear")),
        "facets": F.col("_flips") % 2 == 1,
    }
    listed = items.groupBy("user").agg(*(F.array_sort(F.collect_list(F.when(test, F.col("item")))).alias(name) for name, test in sets.items()))
    empty = F.array().cast("array<string>")
    return viewers.join(listed, "user", "left").select("user", "mode", *(F.coalesce(name, empty).alias(name) for name in sets))
