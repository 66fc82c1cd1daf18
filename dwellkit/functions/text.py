"""Text expressions: parsing of stat strings and ordered role rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from dwellkit.functions.numeric import to_number

# Substrings (case-sensitive) that mark a role as not counted.
EXCLUDED_ROLE_WORDS = [
    "Consultant", "Scout", "Analyst", "Athletic Director", "Advisor", "Intern",
    "Sports Science", "Quality Control", "Emeritus", "Freshman ", "/Freshman",
    "Passing Game Coordinator", "Pass Gm. Coord.", "Recruiting", "Reserve", "earnings",
    "Strength and Conditioning", "Strength & Conditioning", "Video", "Senior Assistant",
    "Associate Head Coach",
]

# Lower-case words of the two unit families.
OFFENSE_WORDS = ["offensive", "quarterback", "running back", "wide receiver", "tight end",
                 "o-line", "passing game", "pass game"]
DEFENSE_WORDS = ["defensive", "linebacker", "defensive back", "secondary", "cornerback",
                 "safet", "d-line", "nickel", "pass rush", "run game coordinator/def"]

# Words in a season note that tell how a spell ended.
FORCED_WORDS = ["fired", "dismiss", "relieved", "let go", "terminated", "released"]
RESIGNED_WORDS = ["resign", "stepped down", "step down", "mutual", "parted", "quit"]
VOLUNTARY_WORDS = ["retire", "health", "illness", "died", "death", "leave of absence"]

# Role patterns (regular expressions, any case) of the two backgrounds.
OFFENSE_PATTERNS = [
    "Offensive Coordinator", r"Off\. Coordinator", "Quarterbacks", "QB Coach", "Quarterback",
    "Running Backs", "RB Coach", "Running Back", "Wide Receivers", "WR Coach",
    "Wide Receiver", "Receivers", "Tight Ends", "TE Coach", "Tight End", "Offensive Line",
    "OL Coach", "O-Line", "Offensive Quality Control", "Offensive Assistant",
    "Offensive Backs", "Passing Game Coordinator", "Run Game Coordinator",
    "Offensive Intern", "Line Coach", "Backfield", "Offensive Backfield", "Ends Coach",
    "Centers", "Guards", "Tackles Coach", "Receivers Coach", "Backs Coach", "Tackles",
    "Offensive Coach", "Play-Caller", "Ends/Centers",
]
DEFENSE_PATTERNS = [
    "Defensive Coordinator", r"Def\. Coordinator", "Linebackers", "LB Coach", "Linebacker",
    "Defensive Backs", "DB Coach", "Secondary", "Cornerbacks", "CB Coach", "Cornerback",
    "Safeties", "Safety", "Defensive Line", "DL Coach", "D-Line", "Defensive Ends",
    "DE Coach", "Defensive Tackles", "DT Coach", "Defensive Quality Control",
    "Defensive Assistant", "Pass Rush Specialist", "Defensive Intern",
    "Defensive Backfield", "Defensive Coach",
]


def contains_any(col: Column, words: list[str]) -> Column:
    """Case-sensitive: does the text hold any of the literal words.

    Plain substring search, which is much cheaper than a regular-expression alternation.
    """
    return reduce(lambda a, b: a | b, [col.contains(w) for w in words])


def keyword_flag(col: Column, words: list[str]) -> Column:
    """Any-case substring flag; missing text has no keyword."""
    return F.coalesce(contains_any(F.lower(col), words), F.lit(False))


def parse_percent(col: Column) -> Column:
    """"41.2%" as 0.412."""
    return to_number(F.regexp_replace(col, "%$", "")) / 100.0


def parse_clock(col: Column) -> Column:
    """"2:31" as minutes."""
    parts = F.split(col, ":")
    return to_number(parts[0]) + to_number(F.element_at(parts, -1)) / 60.0


def parse_last_number(col: Column) -> Column:
    """"Own 27.3" as 27.3: the last blank-separated token."""
    return to_number(F.element_at(F.split(col, " "), -1))


def is_top_level(level: Column, tag: str = "NFL", except_for: str = "NFL Europe") -> Column:
    """Top-level competition unless it is the named exception."""
    return F.coalesce(level.contains(tag) & (level != F.lit(except_for)), F.lit(False))


def classify_level(level: Column, tag: str = "NFL", except_for: str = "NFL Europe",
                   lower_tag: str = "College") -> Column:
    """Lower level first, then top level, else "None"."""
    return (F.when(level.contains(lower_tag), F.lit(lower_tag))
            .when(is_top_level(level, tag, except_for), F.lit(tag))
            .otherwise(F.lit("None")))


def classify_role(role: Column, excluded: list[str] = EXCLUDED_ROLE_WORDS) -> Column:
    """Ordered rules: HC, OC, DC, STC, POS, or NONE for roles that do not count."""
    blank = role.isNull() | (F.trim(role) == "")
    bare_assistant = contains_any(role, ["Assistant", "Asst"]) & ~role.contains("/") & ~role.contains("\\")
    head = role.contains("Head Coach") & ~role.contains("Ass") & ~role.contains("Interim")
    coordinator = role.contains("Coordinator")
    offense = role.contains("Offensive Coordinator") & ~role.contains("Interim O")
    defense = role.contains("Defensive Coordinator") & ~role.contains("Interim D")
    special = role.contains("Special") & ~role.contains("Interim S")
    return (F.when(blank | contains_any(role, excluded) | bare_assistant, "NONE")
            .when(head, "HC")
            .when(coordinator & offense, "OC")
            .when(coordinator & defense, "DC")
            .when(coordinator & special, "STC")
            .otherwise("POS"))


def classify_side(role: Column) -> Column:
    """off / def when exactly one word family matches, else other."""
    off = keyword_flag(role, OFFENSE_WORDS)
    dfn = keyword_flag(role, DEFENSE_WORDS)
    return F.when(off & ~dfn, "off").when(dfn & ~off, "def").otherwise("other")


def pattern_match(role: Column, patterns: list[str]) -> Column:
    """Any-case match of a family of regular expressions."""
    return F.coalesce(role.rlike("(?i)" + "|".join(patterns)), F.lit(False))


def background_of(first: Column, second: Column, names=("Offensive", "Defensive")) -> Column:
    """Both when each count exceeds two, else the larger; a positive tie goes to the first."""
    return (F.when((first > 2) & (second > 2), "Both")
            .when(first > second, names[0])
            .when(second > first, names[1])
            .when(first > 0, names[0])
            .otherwise("Other"))


def unit_column(role_class: Column, offense: Column, defense: Column, net: Column) -> Column:
    """The measure a role answers for: own offence, own defence, or the net result."""
    upper = F.upper(role_class)
    return (F.when(upper.contains("OC"), offense)
            .when(upper.contains("DC"), defense)
            .otherwise(net))


def format_record(won: Column, lost: Column, tied: Column) -> Column:
    """"10-6-1", the ties only when there are any."""
    return F.concat_ws("-", won.cast("string"), lost.cast("string"),
                       F.when(tied > 0, tied.cast("string")))
