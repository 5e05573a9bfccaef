"""Normalizers as Column expressions: each value has a display form to show and a compare form to match by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Titles, street words, unit words and states.
TITLES = ["dr", "doc", "doctor", "prof", "mr", "mrs", "ms", "md", "phd", "do", "rn", "np"]
STREET_WORDS = {
    "st": "street", "st.": "street", "ave": "avenue", "ave.": "avenue", "av": "avenue", "blvd": "boulevard", "blvd.": "boulevard",
    "rd": "road", "rd.": "road", "dr": "drive", "dr.": "drive", "ln": "lane", "ln.": "lane", "ct": "court", "ct.": "court",
    "pl": "place", "pl.": "place", "sq": "square", "sq.": "square", "ter": "terrace", "ter.": "terrace", "pkwy": "parkway", "pkwy.": "parkway",
    "hwy": "highway", "hwy.": "highway", "n": "north", "n.": "north", "s": "south", "s.": "south", "e": "east", "e.": "east", "w": "west", "w.": "west",
    "ne": "northeast", "nw": "northwest", "se": "southeast", "sw": "southwest",
}
UNIT_WORDS = ["suite", "ste", "unit", "apt", "apartment", "fl", "floor", "rm", "room", ""]
STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO", "connecticut": "CT",
    "delaware": "DE", "district of columbia": "DC", "florida": "FL", "georgia": "GA", "hawaii": "HI", "idaho": "ID", "illinois": "IL",
    "indiana": "IN", "iowa": "IA", "kansas": "KS", "kentucky": "KY", "louisiana": "LA", "maine": "ME", "maryland": "MD",
    "massachusetts": "MA", "michigan": "MI", "minnesota": "MN", "mississippi": "MS", "missouri": "MO", "montana": "MT", "nebraska": "NE",
    "nevada": "NV", "new hampshire": "NH", "new jersey": "NJ", "new mexico": "NM", "new york": "NY", "north carolina": "NC",
    "north dakota": "ND", "ohio": "OH", "oklahoma": "OK", "oregon": "OR", "pennsylvania": "PA", "rhode island": "RI",
    "south carolina": "SC", "south dakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT", "virginia": "VA",
    "washington": "WA", "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY",
}


# White space at the ends, as Unicode counts it, and the four separators that also part words.
SPACES = " \t\n\v\f\r\x1c\x1d\x1e\x1f\x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once a row however often body uses it (a Column is pasted wherever it is used)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def mapping(table: dict) -> Column:
    """A map literal from text to text, doubles or nulls, made in one call rather than one for each entry."""
    said = lambda v: "NULL" if v is None else f"{v!r}D" if isinstance(v, float) else "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return F.expr(f"map({', '.join(said(x) for kv in table.items() for x in kv)})")


def derive(df: DataFrame, made: dict[str, Column]) -> DataFrame:
    """df with the columns of `made`, in place of any of the same name.

    They come out of a generator, through which the optimizer neither pushes filters nor merges projections, so each is
    evaluated once a row, whatever later steps do with it.
    """
    return df.select(*[c for c in df.columns if c not in made], F.inline(F.array(F.struct(*[v.alias(k) for k, v in made.items()]))))


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends; null becomes empty."""
    return F.btrim(text(c), F.lit(SPACES))


def squish(c: Column) -> Column:
    """Runs of white space as one space, none at the ends. A text of printable ASCII with single spaces needs no more than a trim."""
    odd = text(c).rlike("[^ -~]|  ")
    return F.when(odd, strip(F.regexp_replace(text(c), r"(?U)[\s\x1c-\x1f]+", " "))).otherwise(F.btrim(text(c)))


def digits(c: Column) -> Column:
    return F.regexp_replace(text(c), r"\D", "")


def _cap(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))


def _runs(w: Column, letters: str) -> Column:
    """Each run of letters with its first one upper and the others lower; all else as it is."""
    runs = F.regexp_extract_all(w, F.lit(f"([{letters}]+|[^{letters}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(f"^[{letters}]"), _cap(r)).otherwise(r)), "")


def _words(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda w: w != "")


def _name_words(c: Column) -> Column:
    """A single comma swaps its two sides, dots part words, titles go."""
    def words(t):
        one = F.length(t) - F.length(F.replace(t, F.lit(","), F.lit(""))) == 1
        t = F.when(one, F.concat_ws(" ", strip(F.split_part(t, F.lit(","), F.lit(2))), strip(F.split_part(t, F.lit(","), F.lit(1))))).otherwise(t)
        return F.filter(_words(squish(F.replace(t, F.lit("."), F.lit(" ")))), lambda w: ~F.btrim(F.lower(w), F.lit("'-")).isin(TITLES))

    return let(strip(c), words)


def _shown_name(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda x: _runs(x, "A-Za-z")), " ")


def _plain_name(words: Column) -> Column:
    return F.translate(F.lower(F.array_join(words, " ")), "'-", "")


def name_display(c: Column) -> Column:
    return _shown_name(_name_words(c))


def name_compare(c: Column) -> Column:
    return _plain_name(_name_words(c))


def name_forms(c: Column) -> Column:
    """struct(display, compare)."""
    return let(_name_words(c), lambda w: F.struct(_shown_name(w).alias("display"), _plain_name(w).alias("compare")))


def specialty_display(c: Column) -> Column:
    return squish(c)


def specialty_compare(c: Column) -> Column:
    return F.lower(squish(c))


def phone_compare(c: Column) -> Column:
    """The ten digits, without a leading country code; anything else is empty."""
    return F.regexp_extract(digits(c), r"^1?([0-9]{10})$", 1)


def phone_display(c: Column) -> Column:
    return F.regexp_replace(phone_compare(c), r"^(\d{3})(\d{3})(\d{4})$", "($1) $2-$3")


def state_code(c: Column) -> Column:
    names = mapping(STATES)
    return let(strip(c), lambda s: F.when(F.length(s) == 2, F.upper(s)).otherwise(F.coalesce(F.try_element_at(names, F.lower(s)), F.upper(s))))


def zip5(c: Column) -> Column:
    return F.substring(digits(c), 1, 5)


def _is_unit(w: Column) -> Column:
    return F.btrim(F.lower(w), F.lit(".#")).isin(UNIT_WORDS)


def _street(street: Column) -> Column:
    """struct(compare, unit): a unit after a comma, or else behind a unit word in the street itself, is taken out; common
    words of the rest are written in full.

    A map literal is searched entry by entry, a list of words by its hash: only words of the table are looked up in it.
    """
    table = mapping(STREET_WORDS)
    whole = lambda t: let(F.lower(F.btrim(t, F.lit(","))), lambda b: F.when(b.isin(list(STREET_WORDS)), F.try_element_at(table, b)).otherwise(b))

    def read(parts):
        named = F.filter(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: (p != "") & _is_unit(F.split_part(p, F.lit(" "), F.lit(1))))
        last = let(F.try_element_at(named, F.lit(-1)), lambda p: F.when(p.isNotNull(), F.try_element_at(F.regexp_extract_all(p, F.lit(r"(?U)(\w+)"), F.lit(1)), F.lit(-1))))
        after = F.when(F.size(parts) > 1, F.coalesce(last, F.lit(""))).otherwise("")
        return let(_words(F.coalesce(F.get(parts, F.lit(0)), F.lit(""))), lambda tokens: F.struct(
            after.alias("after"), tokens.alias("tokens"), F.array_position(F.transform(tokens, _is_unit), True).cast("int").alias("at")))

    def cut(r):
        inside = (r["after"] == "") & (r["at"] > 0)
        kept = F.when(inside, F.slice(r["tokens"], F.lit(1), F.greatest(r["at"] - 1, F.lit(0)))).otherwise(r["tokens"])
        return F.struct(F.trim(F.array_join(F.transform(kept, whole), " ")).alias("compare"),
                        F.when(inside, F.btrim(F.coalesce(F.get(r["tokens"], r["at"]), F.lit("")), F.lit("#"))).otherwise(r["after"]).alias("unit"))

    parts = F.transform(F.split(squish(F.replace(text(street), F.lit("#"), F.lit(" # "))), ","), strip)
    return let(let(parts, read), cut)


def street_forms(street: Column) -> Column:
    """struct(display, compare, unit)."""
    shown = lambda s: F.array_join(F.transform(_words(s), lambda w: F.when(w.rlike(r"^\d"), w).otherwise(_cap(w))), " ")
    return let(_street(street), lambda s: F.struct(shown(s["compare"]).alias("display"), s["compare"].alias("compare"), s["unit"].alias("unit")))


def street_compare(street: Column) -> Column:
    return _street(street)["compare"]


def street_display(street: Column) -> Column:
    return street_forms(street)["display"]


def unit(street: Column) -> Column:
    return _street(street)["unit"]


def city_display(c: Column) -> Column:
    return _runs(squish(c), r"\p{L}")


def location_key(street: Column, city: Column, state: Column, postal: Column, with_unit: bool = True) -> Column:
    """Street, unit (or nothing in its place), city, state and zip to match by, with bars between."""
    return let(_street(street), lambda s: F.concat_ws(
        "|", s["compare"], s["unit"] if with_unit else F.lit(""), F.lower(squish(city)), F.lower(state_code(state)), zip5(postal)))


def compare_form(field: str, c: Column) -> Column:
    """What two values of a field are matched by. Only null and blank are empty: 0 is a value."""
    known = {"phone": phone_compare, "street": street_compare, "specialty": specialty_compare, "name": name_compare,
             "state": lambda x: F.lower(state_code(x)), "zip": zip5}
    return known[field](c) if field in known else F.lower(strip(c))


def display_form(field: str, c: Column) -> Column:
    """What is stored for a field: the tidy form, or the raw text where there is none."""
    known = {"phone": phone_display, "name": name_display, "specialty": specialty_display, "state": state_code}
    return let(known[field](c), lambda d: F.when(d != "", d).otherwise(text(c))) if field in known else text(c)


def display_of(field: Column, fields: list[str], c: Column) -> Column:
    """display_form where the field is a column's value."""
    shown = F
    for f in fields:
        shown = shown.when(field == f, display_form(f, c))
    return shown
