"""Bilingual reasons: sentences for features, and the three that contribute most."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of weekdays, Monday first.
WEEKDAYS = (
    ("Monday", "Somvaar"),
    ("Tuesday", "Mangalvaar"),
    ("Wednesday", "Budhvaar"),
    ("Thursday", "Guruvaar"),
    ("Friday", "Shukravaar"),
    ("Saturday", "Shanivaar"),
    ("Sunday", "Ravivaar"),
)
#: Sentences of 0/1 features, said only when the feature is 1.
FLAGS = {
    "kw_fee": ("Asked about fees", "Fees ke baare mein poocha"),
    "kw_emi": ("Asked about EMI", "EMI ke baare mein poocha"),
    "kw_placement": ("Asked about placements or jobs", "Placement ya job ke baare mein poocha"),
    "kw_timing": ("Asked about timing or batches", "Timing ya batch ke baare mein poocha"),
    "kw_visit": ("Asked about a branch or visit", "Branch ya visit ke baare mein poocha"),
    "kw_demo": ("Asked about a demo or trial", "Demo ya trial ke baare mein poocha"),
    "kw_price_objection": ("Raised a price or budget concern", "Price ya budget ko lekar concern dikhaya"),
    "kw_not_interested": ("Showed a not-interested or cancellation signal", "Not interested ya cancellation ka signal diya"),
    "has_inbound_text_before_t": ("Person sent inbound WhatsApp text in the first 24 hours", "Person ne pehle 24 ghanton mein WhatsApp text bheja"),
    "locality_match_missing": ("Home locality did not match the locality table", "Home locality locality table mein match nahi hui"),
    "has_phone": ("Phone number is available", "Phone number available hai"),
    "has_email": ("Email address is available", "Email address available hai"),
    "has_home_locality": ("Home locality is available", "Home locality available hai"),
    "age_missing": ("Age is missing from the enquiry", "Enquiry mein age missing hai"),
    "education_status_missing": ("Education status is missing", "Education status missing hai"),
}
#: Sentences with a number, its format, and whether an absent number is 0.
NUMBERS = {
    "age": ("Lead age is {}", "Lead ki age {} hai", "%d", False),
    "creation_hour": ("Enquiry arrived around {}:00", "Enquiry lagbhag {}:00 baje aayi", "%02d", False),
    "inbound_msg_count_before_t": ("Person sent {} WhatsApp message(s) in the first 24 hours", "Person ne pehle 24 ghanton mein {} WhatsApp message(s) bheje", "%d", True),
    "outbound_msg_count_before_t": ("{} outbound WhatsApp message(s) were sent in the first 24 hours", "Pehle 24 ghanton mein {} outbound WhatsApp message(s) bheje gaye", "%d", True),
    "mean_msg_len_before_t": ("Average message length was about {} characters", "Average message length lagbhag {} characters tha", ".0", False),
    "calls_attempted_before_t": ("{} counselor call attempt(s) happened in the first 24 hours", "Pehle 24 ghanton mein {} counselor call attempt(s) hue", "%d", True),
    "calls_answered_before_t": ("{} counselor call(s) were answered in the first 24 hours", "Pehle 24 ghanton mein {} counselor call(s) answer hue", "%d", True),
    "min_dist_to_branch": ("Nearest branch is about {} km away", "Nearest branch lagbhag {} km door hai", ".1", False),
}
#: Sentences of latencies, with minutes and without (below 0).
LATENCIES = {
    "mins_to_first_lead_reply_after_assistant": (
        ("Replied to the assistant within about {} minutes", "Assistant ko lagbhag {} minute mein reply kiya"),
        ("No lead reply followed the assistant within 24 hours", "24 ghanton mein assistant ke baad lead ka reply nahi aaya"),
    ),
    "mins_to_first_counselor_call": (
        ("First counselor call was about {} minutes after enquiry", "Pehla counselor call enquiry ke lagbhag {} minute baad hua"),
        ("No counselor call occurred in the first 24 hours", "Pehle 24 ghanton mein counselor call nahi hua"),
    ),
}
#: Sentences of one-hot features base_value, said only for the lead's own value.
CATEGORIES = {
    "source": ("Lead came from {}", "Lead {} se aaya hai"),
    "branch": ("Enquiry is for the {} branch", "Enquiry {} branch ke liye hai"),
    "course": ("Enquiry is for {}", "Enquiry {} course ke liye hai"),
    "education_status": ("Education status is {}", "Education status {} hai"),
}
EMPTY = ("", "")


def _pair(en: Column, hi: Column) -> Column:
    return F.struct(en.alias("en"), hi.alias("hi"))


def _fill(template: str, value: Column) -> Column:
    head, _, tail = template.partition("{}")
    return F.concat(F.lit(head), value, F.lit(tail))


def _format(value: Column, how: str) -> Column:
    """%d forms of the truncated number; .n: n decimals, exact halves to even."""
    if how[0] == ".":
        n = int(how[1:])
        return F.format_string(f"%.{n}f", F.bround(value.cast("double"), n))
    return F.format_string(how, value.cast("int"))


def reason(feature: str, columns: list[str]) -> Column:
    """The sentence pair of a feature for each row, null where it has nothing to say. A transformer's prefix (xx__) is dropped."""
    name = feature.split("__", 1)[1] if "__" in feature else feature
    none = F.lit(None).cast("struct<en:string,hi:string>")
    if name in FLAGS and name in columns:
        return F.when(F.coalesce(F.col(name).cast("int"), F.lit(0)) == 1, _pair(*map(F.lit, FLAGS[name])))
    if name in NUMBERS and name in columns:
        en, hi, how, zero = NUMBERS[name]
        v = F.coalesce(F.col(name), F.lit(0)) if zero else F.col(name)
        return F.when(v.isNotNull(), _pair(_fill(en, _format(v, how)), _fill(hi, _format(v, how))))
    if name in LATENCIES and name in columns:
        said, silent = LATENCIES[name]
        v = F.coalesce(F.col(name), F.lit(-1.0))
        return F.when(v < 0, _pair(*map(F.lit, silent))).otherwise(_pair(*[_fill(t, _format(v, ".0")) for t in said]))
    if name == "creation_weekday" and name in columns:
        names = [F.element_at(F.array(*[F.lit(d[k]) for d in WEEKDAYS]), F.col(name).cast("int") + 1) for k in (0, 1)]
        return F.when(F.col(name).isNotNull(), _pair(_fill("Enquiry arrived on {}", names[0]), _fill("Enquiry {} ko aayi", names[1])))
    for base, (en, hi) in CATEGORIES.items():
        column = "course_interest" if base == "course" and "course" not in columns else base
        for prefix in (f"{column}_", f"{base}_"):
            if name.startswith(prefix) and column in columns:
                value = name[len(prefix) :]
                return F.when(F.col(column).cast("string") == value, _pair(F.lit(en.replace("{}", value)), F.lit(hi.replace("{}", value))))
    return none


def top_reasons(contributions: dict[str, Column], columns: list[str], k: int = 3, least: float = 1e-10) -> Column:
    """The sentences of the k largest contributions by size, ties by feature; features that say nothing are skipped, and blanks fill up."""
    rows = F.array(*[F.struct((-F.abs(c.cast("double"))).alias("s"), F.lit(f).alias("f"), reason(f, columns).alias("r")) for f, c in contributions.items()])
    said = F.filter(rows, lambda x: (x["s"] <= -least) & x["r"].isNotNull())
    found = F.transform(F.slice(F.array_sort(said), 1, k), lambda x: x["r"])
    blanks = F.array_repeat(_pair(*map(F.lit, EMPTY)), k)
    return F.slice(F.concat(found, blanks), 1, k)


def linear_contributions(weights: dict[str, float]) -> dict[str, Column]:
    """Coefficient times value; for trees pass importances as weights."""
    return {f: F.col(f"`{f}`").cast("double") * w for f, w in weights.items()}
