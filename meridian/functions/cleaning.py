"""Field cleaners of the feeds: money, dates, districts, parties, seats, flags. What cannot be read is null unless said otherwise."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the feeds.
PARTIES = {"Democratic": "D", "I": "I", "Nonpartisan": "N", "Republican": "R", "Third-Party": "3", "Unknown": "U"}
OFFICES = {"G": "state:governor", "H": "state:lower", "S": "state:upper", "J": "state:judicial", "K": "state:judicial", "O": "state:office"}
WON_OR_OPEN = ("Pending-General", "Pending-General Runoff", "Pending-Primary", "Pending-Primary Runoff", "Tied-General", "Won-General", "Won-General Runoff", "Won-Primary", "Won-Retention")
LOST = ("Deceased-General", "Disqualified-General", "Disqualified-Primary", "Lost-Convention", "Lost-General", "Lost-General Runoff", "Lost-Primary", "Lost-Primary Runoff", "Lost-Retention", "Lost-Top Two Primary", "Lost-TopTwo Primary Runoff", "Withdrew-General", "Withdrew-Primary")
NO_AMOUNT = ("(see note)", "Intel (No Numbers)")
CHAMBERS = {"H": "h", "S": "s", "J": "j"}


def mapped(value: Column, table: dict, default: Column | None = None) -> Column:
    """The table's value, else the default (null). Short tables only; larger ones are joins."""
    found = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])[value]
    return found if default is None else F.coalesce(found, default)


def money(text: Column) -> Column:
    """Without `$` and commas, as a decimal."""
    return F.regexp_replace(F.trim(text), r"[,$]", "").try_cast("decimal(15,2)")


def earmark_amount(text: Column) -> Column:
    """money(), 0 where there is no number."""
    return F.when(F.trim(text).isin(*NO_AMOUNT), F.lit(0)).otherwise(F.coalesce(money(text), F.lit(0))).cast("decimal(15,2)")


def date_mdy(text: Column) -> Column:
    """MMDDYYYY."""
    return F.try_to_timestamp(F.nullif(F.trim(text), F.lit("")), F.lit("MMddyyyy")).cast("date")


def date_iso(text: Column) -> Column:
    """YYYY-MM-DD; null for an empty, `\\N` or zero date."""
    return F.when(~text.isin("", "\\N", "0000-00-00"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))).cast("date")


def whole(text: Column) -> Column:
    return F.when(~text.isin("", "\\N"), text).try_cast("int")


def id_number(text: Column) -> Column:
    """whole(), null for 0, which stands for none."""
    return F.nullif(whole(text), F.lit(0))


def code(text: Column) -> Column:
    """Null for `\\N` and for XXX, which stands for none."""
    return F.when(~text.isin("\\N", "XXX"), text)


def district(text: Column) -> Column:
    """A number without its ordinal ending; 0 for none."""
    return F.when(text == "", F.lit(0)).otherwise(F.regexp_replace(text, "st|nd|rd|th", "").try_cast("int"))


def two_letter_state(text: Column) -> Column:
    return F.when(F.length(text) == 2, text).otherwise("")


def short_party(text: Column) -> Column:
    return F.when(F.upper(text).isin("D", "R", "I"), F.upper(text)).otherwise("")


def party_of(recipient: Column, committee: Column) -> Column:
    """Recipient's party, or its committee's, as a short code; P is none."""
    own = F.when(F.coalesce(recipient, F.lit("")) == "", mapped(committee, PARTIES, committee)).otherwise(recipient)
    return F.when(own != "P", mapped(own, PARTIES, own))


def candidacy(status: Column) -> Column:
    """True for won, tied and pending, false for lost and withdrawn."""
    return F.when(status.isin(*WON_OR_OPEN), True).when(status.isin(*LOST), False)


def seat_result(status: Column) -> Column:
    return F.when(status.startswith("W") | status.endswith("W"), "W").when(status.startswith("L") | status.endswith("L"), "L")


def state_district(state: Column, text: Column) -> Column:
    number = F.regexp_extract(text, r"^0*([1-9]+\w*)", 1)
    return F.when(number != "", F.concat(state, F.lit("-"), number))


def fec_seat(fec_id: Column) -> Column:
    """Struct seat, state, district of a candidate number."""
    kind, state = F.left(fec_id, F.lit(1)), F.substring(fec_id, 3, 2)
    seat = mapped(kind, {"P": "federal:president", "S": "federal:senate", "H": "federal:house"})
    return F.struct(
        seat.alias("seat"), F.when(kind.isin("S", "H"), state).when(kind == "P", "").alias("state"),
        F.when(kind == "H", F.concat(state, F.lit("-"), F.substring(fec_id, 5, 2))).when(kind.isin("P", "S"), "").alias("district"),
    )


def race_seat(text: Column) -> Column:
    """Struct seat, state, district of a four-letter race: PRES, NYS1, MD04; nulls otherwise."""
    ok, state = F.length(F.trim(text)) == 4, F.left(text, F.lit(2))
    senate = F.substring(text, 3, 1) == "S"
    return F.struct(
        F.when(ok, F.when(text == "PRES", "federal:president").when(senate, "federal:senate").otherwise("federal:house")).alias("seat"),
        F.when(ok, F.when(text == "PRES", "").otherwise(state)).alias("state"),
        F.when(ok, F.when((text == "PRES") | senate, "").otherwise(F.concat(state, F.lit("-"), F.substring(text, 3, 2)))).alias("district"),
    )


def recipient_result(code_: Column) -> Column:
    """Second letter, if it says won or lost."""
    second = F.upper(F.substring(code_, 2, 1))
    return F.when(second.isin("W", "L"), second)


def occupation_pair(both: Column, occupation: Column, employer: Column) -> Column:
    """Struct occupation, employer: the given pair if neither is empty, else the parts of an `employer/occupation` with one slash; other texts are an occupation."""
    parts = F.split(both, "/")
    given = (F.coalesce(occupation, F.lit("")) != "") & (F.coalesce(employer, F.lit("")) != "")
    two = F.size(parts) == 2
    part = lambda i: F.try_element_at(parts, F.lit(i))
    return F.struct(
        F.when(given, occupation).when(two, part(2)).otherwise(F.coalesce(both, F.lit(""))).alias("occupation"),
        F.when(given, employer).when(two, part(1)).otherwise("").alias("employer"),
    )


def contributor_kind(category: Column, name: Column) -> Column:
    """I for a person, C for a group, null where the category says neither. J1, Z2, Z9 are neither; J2, Z1, Z5 and names without a comma are groups."""
    two = F.left(F.coalesce(category, F.lit("")), F.lit(2))
    group = two.isin("J2", "Z1", "Z5") | F.coalesce((name != "") & ~F.contains(name, F.lit(",")), F.lit(False))
    return F.when(~two.isin("J1", "Z2", "Z9"), F.when(group, "C").otherwise("I"))


def refund(kind: Column, amount: Column) -> Column:
    """Types 22y and 22z give back: their amounts are negative."""
    return F.when(F.lower(kind).isin("22y", "22z"), -F.abs(amount)).otherwise(amount)


def flag_yes(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)) == "y", F.lit(False))


def starred_date(text: Column) -> Column:
    """Struct day, starred: a date MM/DD/YYYY that an asterisk may follow."""
    return F.struct(F.try_to_timestamp(F.left(text, F.lit(10)), F.lit("MM/dd/yyyy")).cast("date").alias("day"), F.coalesce(F.endswith(text, F.lit("*")), F.lit(False)).alias("starred"))


def salted_id(id_: Column, salt: str) -> Column:
    return F.md5(F.concat(id_.cast("string"), F.lit(salt)))


def nullable(text: Column) -> Column:
    """`(none)` is empty, `NULL` is null."""
    return F.when(text == "(none)", "").when(text != "NULL", text)


def split_code(text: Column) -> Column:
    """The part before the first colon of `code: meaning`."""
    return F.trim(F.substring_index(text, ":", 1))


def flag_tf(text: Column) -> Column:
    """t for yes, true and 1, f for no, false and 0, else null."""
    t = F.lower(F.trim(text))
    return F.when(t.isin("y", "yes", "true", "t", "1"), "t").when(t.isin("n", "no", "false", "f", "0"), "f")
