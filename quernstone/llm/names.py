"""Linking the spellings of one person or organisation: merge, then match again.

A spelling is reduced to a profile: for a person a family name and given names
(full, initials, nicknames), for an organisation its words and its legal form.
Profiles are blocked by keys under which equal, one edit apart, or abbreviated
names meet. All spellings under a tie key merge; an abbreviated name merges into
the one fuller profile it can stand for and stays apart when there are several.
Merging unites the spellings, initials and nicknames of the profiles; the richer
profiles enter the blocking again, until a round merges nothing.

Nothing is compared pair by pair: keys carry every match, so a name borne by a
third of all rows costs one row per distinct spelling.
"""

from __future__ import annotations

import ast
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.components import least_labels
from quernstone.operators.scratch import Scratch

#: Given names with forms that are neither their beginning nor their end.
NICKNAMES = {
    "alexander": "sasha sascha alec xander sandy",
    "andrew": "andy drew",
    "anthony": "tony",
    "benjamin": "benny",
    "catherine": "cathy kate katie kitty",
    "charles": "charlie chuck",
    "christopher": "kit topher",
    "dorothea": "dora dolly dot dorothy",
    "edward": "eddie ted teddy ned",
    "elizabeth": "liz lizzy betty betsy lisa",
    "francesca": "fran franny cesca",
    "francisco": "paco pancho",
    "frederick": "freddie freddy fritz",
    "gabriela": "gaby gabi",
    "guadalupe": "lupita",
    "henrietta": "hettie hetty etta",
    "henry": "hank harry hal",
    "ignacio": "nacho",
    "james": "jim jimmy jamie",
    "johannes": "hans jan",
    "john": "jack johnny",
    "josephine": "josie jo",
    "katherine": "kathy kate katie kitty kat",
    "lawrence": "larry laurie",
    "leonardo": "lenny",
    "margaret": "maggie meg peggy greta",
    "matthias": "matze matt",
    "michael": "mike mick",
    "nathaniel": "nate nat",
    "oliver": "ollie olly",
    "patricia": "trish patty tricia pat",
    "richard": "rick dick ricky richie",
    "robert": "bob rob bobby robbie",
    "rosalinda": "rosie linda",
    "sebastian": "seb basti",
    "susanna": "sue susie sanna",
    "theodore": "ted teddy theo",
    "ursula": "uschi ulla",
    "valentina": "val tina",
    "victoria": "vicky vicki tori",
    "wilhelmina": "willa mina minnie",
    "william": "bill billy will",
    "yolanda": "yoli",
    "zachary": "zack zach",
}
TITLES = set("dr mr mrs ms miss prof professor rev sir dame herr frau hr fr sr sra srta don dona m mme mlle monsieur madame dhr mevr ing".split())
LEADS = re.compile(r"^(?:organi[sz]ed by|created by|posted by|by|from|team|the family of|family|familie|familia|famille)\s+(?=\S+)", re.I)
TAILS = re.compile(r"[\s,]*(?:(?:and|und|et|y|e|en|&|\+)\s+(?:the\s+)?(?:family|familie|famille|familia|família|gezin|friends|team|co)|[,\s](?:jr|sr|phd|md|esq|ii|iii))\.?\s*$", re.I)
PLACEHOLDERS = re.compile(
    r"^(?:anonymous|anonym|an[oó]nimo|anonyme|anoniem|n\.? ?/? ?a\.?|none|null|nil|nan|unknown|not (?:given|available|specified)|no name|campaign team|the team|team|"
    r"organi[sz]er|campaign organi[sz]er|admin|administrator|user|test|undefined|tbd|name|name none(?: country none)?|[\W_]*)$",
    re.I,
)
LEGAL = set("foundation initiative project trust committee center association society fund club group league union alliance network org organization charity institute council".split())
LEGAL_FORMS = {
    "fdn": "foundation", "fndn": "foundation", "found": "foundation", "init": "initiative", "proj": "project", "tr": "trust", "cttee": "committee", "comm": "committee", "cmte": "committee",
    "ctr": "center", "cntr": "center", "cent": "center", "centre": "center", "assoc": "association", "assn": "association", "soc": "society", "org": "organization", "inst": "institute",
}
#: Marks of a company's or club's registration, which say nothing of its name.
REGISTRATION = set("ltd inc llc gmbh plc corp asbl vzw ngo ev mbh bv nv".split())
#: Words of organisations that tie their name together and mean nothing.
SMALL = set("the of and for in at a de la le du des der die das und et y e van".split())
#: Letters that digits and signs are typed for.
LOOKALIKE = str.maketrans("013457@$", "oleastas")
#: Shortest name that is still matched one edit apart.
LEAST_EDIT = 5
#: Longer words, and spellings of more words, are no names that people mistype; they are matched by their words as they are.
LONGEST_WORD, MOST_WORDS = 40, 16
#: Difference in how often two words lead a name that tells the given name from the family name; below it a name is matched both ways.
CLEAR_ORDER = 3
#: From so many distinct spellings on, a given name is taken as one in its own right,
WELL_KNOWN = 5
#: unless one a letter away leads so many times as many spellings: then it is that name mistyped, however many rows there are.
MISTYPED = 10

_FORMAL_OF: dict[str, set[str]] = {}
for _formal, _short in NICKNAMES.items():
    for _nick in _short.split():
        _FORMAL_OF.setdefault(_nick, set()).add(_formal)



def _short_form(name: str) -> bool:
    """Whether a given name is a nickname, or the beginning or end of a longer known name."""
    return name in _FORMAL_OF or (name not in NICKNAMES and any(f.startswith(name) or (len(name) >= 4 and f.endswith(name)) for f in NICKNAMES))


_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*\.?")


def _fold(text: str) -> str:
    text = unicodedata.normalize("NFKD", text)
    return "".join(c for c in text if not unicodedata.combining(c))


def unwrap(text: str) -> str:
    """The name inside a printed record such as ``{'name': 'A. B', 'country': None}`` or ``Name A B Country C``."""
    text = text.strip()
    if text[:1] == "{" and "name" in text.lower():
        try:
            return str(ast.literal_eval(text).get("name") or "")
        except (ValueError, SyntaxError, AttributeError, MemoryError, RecursionError):
            found = re.search(r"(?i)[\"']name[\"']\s*:\s*[\"']([^\"']*)[\"']", text)
            return found[1] if found else ""
    found = re.match(r"(?i)^name\s+(.*?)\s+country\s+\S+$", text)
    return "" if found and found[1].lower() == "none" else found[1] if found else text


def profile(spelling: str) -> dict | None:
    """The parts of a spelling, or None for placeholders and spellings without letters."""
    text = unwrap(spelling)
    if PLACEHOLDERS.match(text.strip()):
        return None
    nicks = [_fold(x).lower().strip() for pair in re.findall(r"[\"“”„]([^\"“”„]+)[\"“”]|\(([^()]+)\)", text) for x in pair if x.strip()]
    text = re.sub(r"[\"“”„][^\"“”„]+[\"“”]|\([^()]+\)", " ", text)
    text = TAILS.sub("", text.strip())
    text = LEADS.sub("", text)
    comma = "," in text.strip(" ,.;")
    text = text.replace("&", " and ")
    if not re.search(r"\s", text.strip()):
        text = re.sub(r"(?<=[^\W\d_A-Z])(?=[A-Z])", " ", _fold(text))
    words = []
    for raw in _TOKEN.findall(_fold(text)):
        low = raw.lower().replace("'", "").replace("’", "")
        bare = low.rstrip(".")
        if re.search(r"[a-z]", bare) or not bare.isascii():
            bare = bare.translate(LOOKALIKE) if re.search(r"[a-z]", bare) else bare
        words.append((bare, low.endswith(".")))
    # "M. X" may be an initial; only before two names is it a title.
    while len(words) > 1 and words[0][0] in TITLES and (len(words[0][0]) > 1 or (words[0][1] and sum(len(w) > 1 for w, _ in words) > 1)):
        words = words[1:]
    if len(words) > 2 and comma and words[-1][0] in TITLES:
        words = words[:-1]
    tokens = [w for w, _ in words if len(w) > 1]
    initials = [w for w, _ in words if len(w) == 1]
    if not tokens or not any(c.isalpha() for c in "".join(tokens)):
        return None
    content = [LEGAL_FORMS.get(t, t) for t in tokens if t not in SMALL]
    if len(content) > 2:
        content = [t for t in content if t not in REGISTRATION]
    if len(tokens) > MOST_WORDS or max(map(len, tokens)) > LONGEST_WORD:
        return {"kind": "W", "tokens": sorted(tokens), "initials": [], "nicks": [], "part": "", "comma": False, "given": None}
    legal = [t for t in content if t in LEGAL]
    if len(content) >= 3 or (legal and len(content) >= 2):
        rest = sorted(t for t in content if t not in LEGAL) or sorted(content)
        short = [f"{t} {''.join(c[0] for j, c in enumerate(content) if j != i)}" for i, t in enumerate(content) if len(t) >= LEAST_EDIT and t not in LEGAL]
        return {"kind": "O", "tokens": rest, "initials": [], "nicks": short, "part": " ".join(sorted(set(legal))), "comma": False, "given": None}
    told = [i for i, t in enumerate(tokens) if t in NICKNAMES or t in _FORMAL_OF]
    return {"kind": "P", "tokens": tokens, "initials": initials, "nicks": sorted(set(nicks)), "part": "", "comma": comma, "given": told[0] if len(told) == 1 else None}


_PROFILE = pa.schema([("id", pa.int64()), ("kind", pa.string()), ("tokens", pa.list_(pa.string())), ("initials", pa.list_(pa.string())), ("nicks", pa.list_(pa.string())), ("part", pa.string()), ("comma", pa.bool_()), ("given", pa.int32())])
_PROFILE_DDL = "id long, kind string, tokens array<string>, initials array<string>, nicks array<string>, part string, comma boolean, given int"


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [{"id": i} | p for i, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (p := profile(s))]
        yield pa.RecordBatch.from_pylist(rows, schema=_PROFILE)


def _edits(name: str) -> set[str]:
    """``name`` and, if it is long enough, all strings with one letter of it left out."""
    return {name} | ({name[:i] + name[i + 1 :] for i in range(len(name))} if len(name) >= LEAST_EDIT else set())


def _base_edits(kind: str, base: str) -> set[str]:
    if kind == "P":
        return _edits(base)
    words = base.split(" ")
    return {" ".join(sorted([*words[:i], "~" + v, *words[i + 1 :]])) for i, w in enumerate(words) for v in _edits(w)} if len(words) > 1 else _edits(base)


_ROLES = {"tie": 0, "full": 1, "short": 2}


def keys_of(kind: str, base: str, part: str, form: str, well_known: bool) -> list[tuple[str, str, str | None]]:
    """(key, role, known given name) of one line of a profile.

    Role ``tie``: all under the key merge. ``full``: an abbreviation may mean this
    profile. ``short``: this abbreviation means whatever single profile is full
    under the key.
    """
    out: list[tuple[str, str, str | None]] = []
    if form == "whole":
        return [(f"1|{kind}|{base}", "tie", None)]
    if form == "long":
        return [(f"a|{v}|{part}", "full", None) for v in _edits(base)]
    if form == "single":
        out.append((f"1|{kind}|{base}", "tie", None))
        out.append((f"c|{base}", "short", None))
        if len(base) > LEAST_EDIT:
            out += [(f"p|P|{base[1:]}|{base[0]}", "short", None), (f"p|P|{base[:-1]}|{base[-1]}", "short", None)]
        return out
    if form == "initial":
        out.append((f"1|{kind}|{base}|{part}.", "tie", None))
        out += [(f"i|{kind}|{v}|{part[:1]}", "short", None) for v in _base_edits(kind, base)]
        return out
    if form == "none":
        out += [(f"2|{kind}|{v}|", "tie", None) for v in _base_edits(kind, base)]
        out += [(f"n|{kind}|{v}", "short", None) for v in _base_edits(kind, base)]
        return out
    formals = _FORMAL_OF.get(part, set()) if kind == "P" else set()
    formal = next(iter(formals)) if len(formals) == 1 else part
    own_name = formal in NICKNAMES or (well_known and not _short_form(part))
    known = formal if kind == "O" or own_name else None
    out += [(f"2|{kind}|{v}|{formal}", "tie", None) for v in _base_edits(kind, base)]
    out += [(f"3|{kind}|{base}|{v}", "tie", known) for v in _edits(part) | _edits(formal)]
    if kind == "O":
        return out + [(f"n|{kind}|{v}", "full", None) for v in _base_edits(kind, base)]
    out += [(f"c|{g}{base}", "full", None) for g in {part, *NICKNAMES.get(formal, "").split(), *(part[:k] for k in range(3, len(part)))}]
    out.append((f"c|{base}{part}", "full", None))
    out += [(f"p|P|{base}|{part[:k]}", "full", None) for k in range(1, len(part))]
    out += [(f"s|P|{base}|{part[-k:]}", "full", None) for k in range(4, len(part))]
    out += [(f"i|P|{v}|{part[0]}", "full", None) for v in _base_edits(kind, base)]
    out.append((f"f|P|{base}|{formal}", "full", None))
    if 2 <= len(part) <= 6:
        out += [(f"a|{v}|{part}", "short", None) for v in _edits(base)]
    if 2 <= len(base) <= 6:
        out += [(f"a|{v}|{base}", "short", None) for v in _edits(part)]
    if not own_name:
        out += [(f"p|P|{base}|{part}", "short", None), (f"s|P|{base}|{part}", "short", None)]
    out += [(f"f|P|{base}|{f}", "short", None) for f in formals if len(formals) > 1]
    return out


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (entity, kind, base, part, form, well_known): the keys as 64-bit hashes."""
    number = xxhash.xxh3_64_intdigest
    for batch in batches:
        keys, roles, known, counts = [], [], [], []
        columns = [batch.column(i).to_pylist() for i in range(1, 6)]
        for row in zip(*columns):
            made = keys_of(*row)
            counts.append(len(made))
            for key, role, name in made:
                keys.append(number(key))
                roles.append(_ROLES[role])
                known.append(None if name is None else number(name) >> 1)
        entity = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array(keys, dtype=np.uint64).view(np.int64)), pa.array(roles, pa.int8()), pa.array(known, pa.int64()), pa.array(entity)], names=["key", "role", "known", "entity"]
        )


def _uses(pairs: DataFrame) -> DataFrame:
    """How often each word leads (+1) or ends (-1) a name of two words, and how often it leads."""
    uses = pairs.select(F.explode(F.array(F.struct(F.col("t")[0].alias("token"), F.lit(1).alias("g")), F.struct(F.col("t")[1].alias("token"), F.lit(-1).alias("g")))).alias("u"))
    return uses.groupBy("u.token").agg(F.sum("u.g").alias("lead"), F.sum(F.when(F.col("u.g") > 0, 1).otherwise(0)).alias("n_given"))


def _well_known(uses: DataFrame) -> DataFrame:
    """``uses`` with ``well_known``: given names in their own right, by their own count and that of the names one edit away."""
    longer = uses.where((F.col("n_given") > 0) & (F.length("token") >= LEAST_EDIT))
    cut = F.transform(F.sequence(F.lit(1), F.length("token")), lambda i: F.concat(F.substring("token", F.lit(1), i - 1), F.substring("token", i + 1, F.length("token"))))
    forms = longer.select("token", "n_given", F.explode(F.array_distinct(F.concat(F.array("token"), cut))).alias("form"))
    top = forms.groupBy("form").agg(F.max("n_given").alias("top"))
    near = forms.join(top, "form").groupBy("token").agg(F.max("top").alias("top"))
    known = (F.col("n_given") >= WELL_KNOWN) & (F.coalesce("top", F.lit(0)) < F.col("n_given") * MISTYPED)
    return uses.join(near, "token", "left").select("token", "lead", "n_given", known.alias("well_known"))


def given_names(df: DataFrame, name_col: str, most: int = 200_000) -> list[str]:
    """The given names of a column of names, told by their use: those of the most frequent among different spellings.

    ``most`` bounds what reaches the driver; it is a documented bound of the gazetteer,
    beyond which names are proposed by their context only.
    """
    spellings = df.select(F.col(name_col).cast("string").alias("spelling")).where(F.trim("spelling") != "").distinct()
    people = spellings.select(F.lit(0).cast("long").alias("id"), "spelling").mapInArrow(_profiles, _PROFILE_DDL).where("kind = 'P' AND size(tokens) = 2")
    uses = _uses(people.select(F.when(F.col("comma"), F.reverse("tokens")).otherwise(F.col("tokens")).alias("t")))
    found = _well_known(uses).where((F.col("lead") >= CLEAR_ORDER) & F.col("well_known") & (F.length("token") > 2)).orderBy(F.desc("n_given"), "token").limit(most)
    return [r.token for r in found.collect()]


def _lines(parsed: DataFrame) -> DataFrame:
    """Profile lines (id, kind, base, part, form, well_known), the given name of a person told by how names are used."""
    people = parsed.where("kind = 'P'")
    sorted_out = F.col("comma") | F.col("given").isNotNull()
    given_first = F.when(F.col("given") == 1, F.reverse("tokens")).when(F.col("given") == 0, F.col("tokens")).when(F.col("comma"), F.reverse("tokens")).otherwise(F.col("tokens"))
    pairs = people.where(F.size("tokens") == 2).select("id", given_first.alias("t"), sorted_out.alias("sure"), "nicks")
    uses = _well_known(_uses(pairs))
    at = lambda i: uses.select(F.col("token").alias(f"t{i}"), F.col("lead").alias(f"lead{i}"), F.col("well_known").alias(f"n{i}"))
    told = pairs.select("id", "sure", "nicks", F.col("t")[0].alias("t0"), F.col("t")[1].alias("t1")).join(at(0), "t0").join(at(1), "t1")
    swap = ~F.col("sure") & (F.col("lead1") > F.col("lead0"))
    clear = F.col("sure") | (F.abs(F.col("lead0") - F.col("lead1")) >= CLEAR_ORDER)
    base, given = F.when(swap, F.col("t0")).otherwise(F.col("t1")), F.when(swap, F.col("t1")).otherwise(F.col("t0"))
    well = F.when(swap, F.col("n1")).otherwise(F.col("n0"))
    full = told.select("id", base.alias("base"), given.alias("part"), well.alias("well_known"), "nicks", F.when(clear, "full").otherwise("maybe").alias("form"))
    other = told.where(~clear).select("id", given.alias("base"), base.alias("part"), F.lit(False).alias("well_known"), "nicks", F.lit("maybe").alias("form"))
    nick = full.select("id", "base", F.explode("nicks").alias("part"), F.lit(False).alias("well_known"), "form").where("part rlike '^[^ ]{2,}$'")
    named = full.unionByName(other).drop("nicks").unionByName(nick)
    lone = people.where(F.size("tokens") == 1)
    initial = lone.where(F.size("initials") > 0).select("id", F.col("tokens")[0].alias("base"), F.array_join("initials", "").alias("part"), F.lit(False).alias("well_known"), F.lit("initial").alias("form"))
    single = lone.where(F.size("initials") == 0).select("id", F.col("tokens")[0].alias("base"), F.lit("").alias("part"), F.lit(False).alias("well_known"), F.lit("single").alias("form"))
    persons = named.unionByName(initial).unionByName(single).withColumn("kind", F.lit("P"))
    bodies = parsed.where("kind = 'O'").select("id", F.array_join("tokens", " ").alias("base"), "part", F.lit(False).alias("well_known"), F.when(F.col("part") == "", "none").otherwise("full").alias("form"), "kind")
    acronym = parsed.where("kind = 'O'").select("id", F.explode("nicks").alias("s"), "kind")
    acronym = acronym.select("id", F.split("s", " ")[0].alias("base"), F.split("s", " ")[1].alias("part"), F.lit(False).alias("well_known"), F.lit("long").alias("form"), "kind")
    whole = parsed.where("kind = 'W'").select("id", F.array_join("tokens", " ").alias("base"), "part", F.lit(False).alias("well_known"), F.lit("whole").alias("form"), "kind")
    return persons.unionByName(bodies).unionByName(acronym).unionByName(whole)


def _keys_of_profiles(lines: DataFrame, entities: DataFrame) -> DataFrame:
    """The keys under which the entities' present profiles meet others."""
    rows = lines.join(entities, "id").select("entity", "kind", "base", "part", "form", "well_known").distinct()
    # A united profile carries every name its spellings have: each given name with the usual family name and each family name with the usual given name.
    full = rows.where("form = 'full' AND kind = 'P'")
    several = full.groupBy("entity").agg(
        F.mode("base", True).alias("ub"), F.max(F.struct("well_known", F.length("part").alias("n"), "part")).alias("up"), F.min("base").alias("b0"), F.max("base").alias("b1"), F.min("part").alias("p0"), F.max("part").alias("p1")
    )
    joined = full.join(several.where("b0 <> b1 AND p0 <> p1"), "entity")
    richer = joined.select("entity", "kind", F.col("ub").alias("base"), "part", "form", "well_known").unionByName(joined.select("entity", "kind", "base", F.col("up.part").alias("part"), "form", F.col("up.well_known").alias("well_known")))
    # A number of partitions of its own: the lines are few bytes but make many keys, so they must not end up in one task.
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.unionByName(richer).repartition(parts, "entity").distinct().select("entity", "kind", "base", "part", "form", "well_known").mapInArrow(_key_rows, "key long, role byte, known long, entity long")


def _ties(keyed: DataFrame) -> DataFrame:
    """(``v``, ``tie``) of all merges that the keys call for."""
    # One state per key, combined in each partition: whole groups are never gathered.
    full = F.when(F.col("role") != _ROLES["short"], F.col("entity"))
    state = keyed.groupBy("key").agg(
        F.min("entity").alias("lo"), F.max("entity").alias("hi"), F.min(full).alias("full_lo"), F.max(full).alias("full_hi"), F.min("known").alias("known_lo"), F.max("known").alias("known_hi"), F.min("role").alias("role")
    )
    # Two well-known given names an edit apart are two people; an abbreviation of several profiles stays apart.
    one_name = F.col("known_lo").isNull() | (F.col("known_lo") == F.col("known_hi"))
    merging = F.when(F.col("role") == _ROLES["tie"], one_name).otherwise(F.col("full_lo") == F.col("full_hi"))
    return keyed.join(state.where((F.col("lo") != F.col("hi")) & merging).select("key"), "key").select(F.col("entity").alias("v"), F.col("key").alias("tie")).distinct()


def entities_of_names(df: DataFrame, name_col: str, *, rounds: int = 12, label: str = "names") -> DataFrame:
    """One row per distinct spelling that names someone: ``spelling`` and ``entity`` (the least spelling of its entity).

    Null, blank and placeholder spellings name nobody and are left out. Repeated
    rows change nothing, further columns are ignored, an empty input gives an empty
    result, and spellings are compared as written. Spellings of more than MOST_WORDS
    words or with a word of more than LONGEST_WORD letters are one entity with those
    of the same words, in any order, and with no others. Keys are compared by 64-bit
    hashes. Raises if merges still happen after ``rounds`` rounds.
    """
    scratch = Scratch(df.sparkSession, label)
    spellings = df.select(F.col(name_col).cast("string").alias("spelling")).where(F.trim("spelling") != "").distinct()
    spellings = scratch.save(spellings.withColumn("id", F.monotonically_increasing_id()))
    parsed = scratch.save(spellings.select("id", "spelling").mapInArrow(_profiles, _PROFILE_DDL))
    lines = scratch.save(_lines(parsed))
    entities = scratch.save(lines.select("id", F.col("id").alias("entity")).distinct())
    for _ in range(rounds):
        keyed = scratch.save(_keys_of_profiles(lines, entities))
        ties = scratch.save(_ties(keyed))
        scratch.drop(keyed)
        if not ties.limit(1).count():
            named = entities.join(spellings, "id")
            least = named.groupBy("entity").agg(F.min("spelling").alias("least"))
            return named.join(least, "entity").select("spelling", F.col("least").alias("entity"))
        merged = least_labels(ties, scratch, 60)
        entities = scratch.save(entities.join(merged.select(F.col("v").alias("entity"), "l"), "entity", "left").select("id", F.coalesce("l", "entity").alias("entity")))
    raise RuntimeError(f"profiles still merge after {rounds} rounds")


def spelling_pairs(df: DataFrame, name_col: str, **options) -> DataFrame:
    """All pairs ``a < b`` of spellings of one entity."""
    found = entities_of_names(df, name_col, **options)
    return found.select("entity", F.col("spelling").alias("a")).join(found.select("entity", F.col("spelling").alias("b")), "entity").where("a < b").select("a", "b")
