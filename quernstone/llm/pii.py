"""Personal information in free text: weak labellers, reconciled by expectation-maximisation.

Patterns and gazetteers propose spans. Labellers of three kinds (shape, gazetteer,
context) vote on every span or abstain. Expectation-maximisation over the vote
patterns of all spans estimates how far each labeller can be trusted and what each
span is; a final classifier over votes, shapes and neighbouring words is trained on
that and decides. Only counts of vote patterns and a bounded sample of spans reach
the driver.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.language import COMMON
from quernstone.llm.names import NICKNAMES, TITLES
from quernstone.llm.sample import hashed_sample
from quernstone.operators.scratch import Scratch

#: Spans at most that the final classifier is trained on, picked by a hash of their place.
TRAIN_SPANS = 20_000
#: Hashed features of the final classifier.
DIMENSIONS = 1 << 12

#: What a proposal can turn out to be; the last class is nothing personal.
CLASSES = {"email": ("email", ""), "number": ("phone", "id_number", ""), "address": ("address", ""), "name": ("person_name", "")}
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "person_name": "[PERSON_NAME]"}

_STOP_WORDS = set(" ".join(COMMON.values()).split()) | set("they box mr mrs after before please thanks thank no yes every each since".split())
GIVEN = set(NICKNAMES) | {n for x in NICKNAMES.values() for n in x.split() if len(n) > 2} | set("alex ben chris fred leo hannes thea mina rosa rob lupe bastian".split())
GIVEN -= {"will", "dot", "hal", "art", "may"}
_STREET = "street st lane road rd avenue ave court ct close drive way quay place square terrace row crescent hill walk gardens boulevard blvd".split()
_STREET_BEFORE = "rue avenue avenida calle rua plaza place boulevard chemin travessa via paseo camino largo praça quai allée impasse".split()
_STREET_END = "straße strasse str weg gasse allee platz ring damm ufer straat laan plein gracht kade steeg dijk".split()
PHONE_WORDS = "tel tel. phone telephone telefon téléphone teléfono telefone telefoon call text ring anrufe anrufen reached under unter appelez appeler llamen llame ligue liguem bel bellen mobile mobil handy cell whatsapp fax on au en op 电话 電話".split()
ID_WORDS = (
    "passport passeport pasaporte paspoort passaporte reisepass pass id identity ausweis personalausweis documento dni nie nif cpf bsn ssn social security insurance steuernummer steuer-id tax "
    "licence license führerschein identité identiteitskaart sofinummer 身份证 护照 パスポート 番号"
).split()
NOT_PII_WORDS = "invoice rechnung rechnungsnummer facture factura fatura factuur bus room raum zimmer salle sala kamer batch charge lot lote partij order bestellung commande pedido bestelling receipt score train zug version article artikel".split()
NAME_CUES = "ask demandez demander pregunten preguntar pergunte pergunten fragen vraag contact contactez thanks dank danke merci gracias obrigado bedankt names signed by from for to an por à bij naar with mit avec con met and und et y e en sowie auch also".split()
ADDRESS_CUES = "at to an in der den au à a la en naar address adresse dirección endereço adres lives wohnt letters parcels pakete colis paquetes pakketten blankets off".split()
ORG_WORDS = set("foundation initiative project trust committee center centre association society fund club group school hospital clinic church verein stiftung fondation fundación stichting street lane road avenue court close quay rd ave bridge station park".split())

_CAP = r"[A-ZÀ-ÖØ-Þ]"
_FAMILY = rf"(?:(?:van der|van den|van de|van|von|de la|de|del|da|dos|du|di|le|la)\s)?(?:Mc|Mac|O['’]|D['’])?{_CAP}[\w’']*\w(?:-(?:Mc|O['’])?{_CAP}\w+)*"
_MIDDLE = rf"(?:\s{_CAP}\.?(?=\s))*"
_AFTER_GIVEN = re.compile(rf"{_MIDDLE}\s({_FAMILY})")
_AFTER_GIVEN_SMALL = re.compile(r"(?:\s[a-z]\.)?\s((?:mc|o['’])?[^\W\d_]{3,}(?:-[^\W\d_]+)?)")
_INITIALED = re.compile(rf"(?<![\w.&])(?:{_CAP}\.\s?){{1,2}}(?!\w\.)({_FAMILY})")
_TWO_CAPS = re.compile(rf"({_CAP}\w+){_MIDDLE}\s({_FAMILY})")
_EMAIL = re.compile(
    r"[A-Za-z0-9][\w.+'-]*\s?(?:@|\(at\)|\[at\]|\{at\}|\(@\)|\[@\])\s?[A-Za-z0-9][\w-]*(?:\s?(?:\.|\(dot\)|\[dot\]|\{dot\})\s?[A-Za-z0-9][\w-]*|\sdot\s[A-Za-z0-9][\w-]*)+|"
    r"[A-Za-z0-9][\w.+'-]*\sat\s[A-Za-z0-9][\w-]*(?:\sdot\s[A-Za-z0-9][\w-]*)+",
    re.I,
)
_SEP = r"(?:[ .\-/]|\s/\s|\)\s?)"
_NUMBER = re.compile(
    rf"(?<![\w@.+/-])(?:\+\s?|\()?\d{{1,11}}(?:{_SEP}\(?\d{{1,11}})*(?:\s?(?i:ext\.?|extension|x|durchwahl|dw\.?|poste|toestel|tst\.?|ramal|int\.?)\s?\d{{1,5}})?(?:-?[A-Z](?![\w@]))?(?![\w@])|(?<![\w@])[A-Za-z]{{1,3}}-?\d{{5,9}}(?![\w@])"
)
_QUICK_NUMBER = re.compile(r"\d[\d ().\-/]{4,}\d|[A-Za-z]-?\d{5}")
_DATE = re.compile(r"^(?:\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4})$")
_PHONE_SHAPE = re.compile(r"^(?:\+|00\d)|^\(\d{2,4}\)|^\d{3}[ .-]\d{3}[ .-]\d{4}(?:\D|$)|^\d{3}-\d{4}(?:\D|$)|(?:ext|x|durchwahl|poste|toestel|ramal)\.?\s?\d+$", re.I)
_ID_SHAPE = re.compile(r"^[A-Za-z]{1,3}[ -]?\d{5,9}$|^\d{3}[- ]?\d{2}[- ]\d{4}$|^\d{6}-\d{4}$|^\d{2} \d{3} \d{3} \d{3}$|^\d{9}$|^\d{11}$|^\d{7,9}-?[A-Z]$")

_TOWN = rf"{_CAP}[\w’'-]+"
_TAIL = (
    rf"(?:,?\s(?:Apt|Apartment|Unit|Suite|Flat|Wohnung|Whg|App|Apto|piso|bus)\.?\s?\w+)?"
    rf"(?:,?\s(?:in\s)?\d{{4,5}}(?:-\d{{3}})?\s{_TOWN}|,?\sin\s{_TOWN}(?:\s\d{{4,5}}(?!\w))?|,\s{_TOWN}(?:\s\d{{4,5}}(?!\w))?)?"
)
_ADDRESS = [
    re.compile(rf"(?<![\w-])\d{{1,4}}[a-z]?\s(?:{_CAP}[\w’']+\s){{1,4}}(?:{'|'.join(w.capitalize() for w in _STREET)})\b\.?{_TAIL}"),
    re.compile(
        rf"(?<![\w-])(?:\d{{1,4}}[a-z]?,?\s)?(?:{'|'.join(w.capitalize() for w in _STREET_BEFORE)})\s(?:(?:de la|de las|de los|du|des|del|de|do|da|dos|das|la|el)\s|[dl]['’])?{_CAP}[\w’'-]+"
        rf"(?:,?\s(?:n\.?\s?[º°o]\.?\s?)?\d{{1,4}}[a-z]?(?![\w]))?{_TAIL}"
    ),
    re.compile(rf"(?<![\w-])(?:{_CAP}\w+[\s-])?(?:{_CAP}\w*?(?:{'|'.join(_STREET_END)})|{_CAP}\w+[\s-](?:{'|'.join(w.capitalize() for w in _STREET_END)}))\.?\s\d{{1,4}}\s?[a-z]?(?!\w){_TAIL}"),
    re.compile(rf"(?<!\w)(?:P\.?\s?O\.?\s?Box|Postfach|Bo[iî]te [Pp]ostale|B\.?P\.|Apartado(?: de [Cc]orreos)?|Caixa [Pp]ostal|Postbus)\s\d+{_TAIL}", re.I),
]
_ADDRESS_AT = re.compile(rf"(?<!\w)(?:Am|Im|Zum|Zur|An der|Auf der|In der|Unter den|Hinter dem)\s{_CAP}\w+\s\d{{1,4}}\s?[a-z]?(?!\w){_TAIL}")
_FLAT = str.maketrans({c: " " for c in "\n\r\t.,;:!?()[]{}\"'“”‘’«»„<>/\\|*_#-–—。，、！？：；「」『』（）·"})


class Gazetteer:
    """The words that proposals start from, and the given names among them."""

    def __init__(self, given: frozenset[str] = frozenset()) -> None:
        self.given = GIVEN | {w for w in given if len(w) > 2 and w not in _STOP_WORDS and w not in ORG_WORDS}
        self.words = _automaton(self.given)


def _automaton(given: set[str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for w in given:
        found.add_word(f" {w} ", ("given", len(w)))
    for w in (*_STREET, *_STREET_BEFORE, "postfach", "postbus", "apartado", "box", "postale", "postal", "bp", "b p"):
        found.add_word(f" {w} ", ("street", len(w)))
    for w in _STREET_END:
        found.add_word(f"{w} ", ("street", len(w)))
    for w in ("ask", "demandez", "pregunten por", "fragen an", "vraag naar", "vraag", "pergunte por", "letters go to", "names", "thanks to", "and also", *(t for t in TITLES if len(t) > 1)):
        found.add_word(f" {w} ", ("cue", len(w)))
    found.make_automaton()
    return found


def _words_before(text: str, at: int, n: int = 6) -> list[str]:
    return text[max(0, at - 60) : at].lower().translate(_FLAT).split()[-n:]


def _words_after(text: str, at: int, n: int = 4) -> list[str]:
    return text[at : at + 40].lower().translate(_FLAT).split()[:n]


def _names(text: str, hits: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    for kind, start, end in hits:
        if kind == "given":
            if text[start].isupper():
                m = _AFTER_GIVEN.match(text, end)
            else:
                m = _AFTER_GIVEN_SMALL.match(text, end)
            if m and m[1].lower() not in _STOP_WORDS:
                yield start, m.end()
        elif kind == "cue":
            m = _TWO_CAPS.match(text, min(len(text), end + (1 if text[end : end + 1] != "." else 2)))
            if m and m[1].lower() not in _STOP_WORDS and m[2].lower() not in _STOP_WORDS and m[1].lower() not in TITLES:
                yield m.start(), m.end()
    for m in _INITIALED.finditer(text):
        if m[1].lower() not in _STOP_WORDS and not text[max(0, m.start() - 3) : m.start()].endswith((". ", "z. ", "d. ")):
            yield m.start(), m.end()


def proposals(text: str, gazetteer: Gazetteer) -> list[tuple[str, int, int]]:
    """(family, start, end) of all proposed spans, none overlapping another."""
    low = text.lower()
    if len(low) != len(text):
        # Letters whose small form is longer stay as they are, so places stay true.
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    flat = " " + low.translate(_FLAT) + " "
    hits = []
    street = False
    for last, (kind, length) in gazetteer.words.iter(flat):
        street |= kind == "street"
        if kind != "street":
            hits.append((kind, last - length - 1, last - 1))
    found: list[tuple[str, int, int]] = []
    starts: list[int] = []
    ends: list[int] = []

    def take(family: str, a: int, b: int) -> None:
        """Add a span that overlaps none there is; spans are kept in order."""
        at = bisect_left(starts, b)
        if at and ends[at - 1] > a:
            return
        starts.insert(at, a)
        ends.insert(at, b)
        found.append((family, a, b))

    if "@" in text or "at)" in low or "at]" in low or "at}" in low or " dot " in low:
        for m in _EMAIL.finditer(text):
            take("email", m.start(), m.end())
    for pattern in (*_ADDRESS, _ADDRESS_AT) if street else (_ADDRESS_AT,):
        for m in pattern.finditer(text):
            if any(c.isdigit() for c in m[0]):
                take("address", m.start(), m.end())
    if _QUICK_NUMBER.search(text):
        for m in _NUMBER.finditer(text):
            digits = sum(c.isdigit() for c in m[0])
            if 5 <= digits <= 17 and (digits >= 7 or m[0][0].isalpha()):
                take("number", m.start(), m.end())
    for a, b in sorted(set(_names(text, hits)), key=lambda x: (x[0], -x[1])):
        take("name", a, b)
    return found


def votes(family: str, text: str, a: int, b: int, gazetteer: Gazetteer) -> list[int]:
    """The labellers' votes on one span: a class of its family, or -1."""
    span, before, after = text[a:b], _words_before(text, a), _words_after(text, b)
    near = before[-4:]
    if family == "email":
        return [
            0 if re.search(r"@|\bat\b", span, re.I) and re.search(r"\.\w+$|dot\s?\W?\s?\w+$", span, re.I) else 1,
            0 if any(w.startswith(("mail", "e-mail", "write", "schr", "escr", "écri", "reach", "address", "contact", "receipts", "belege")) for w in before) else -1,
            1 if " at " in span and " dot " not in span.lower() else -1,
        ]
    if family == "number":
        first = span[0]
        return [
            0 if _PHONE_SHAPE.search(span) else -1,
            1 if _ID_SHAPE.search(span) and first != "+" else -1,
            2 if _DATE.match(span) or re.match(r"^\d+[.,]\d+$", span) else -1,
            0 if any(w in PHONE_WORDS for w in near) else -1,
            1 if any(w in ID_WORDS for w in before) else -1,
            2 if any(w in NOT_PII_WORDS for w in near) else -1,
            2 if sum(c.isdigit() for c in span) < 7 and not first.isalpha() else -1,
        ]
    if family == "address":
        return [
            0 if re.search(r"\d", span) else 1,
            0 if any(w in ADDRESS_CUES for w in near) else -1,
            0 if re.search(r",\s|\sin\s|\bbox\b", span, re.I) else -1,
            1 if any(w in NOT_PII_WORDS for w in near[-2:]) else -1,
        ]
    words = [w.strip(".") for w in re.split(r"[\s]+", span.lower())]
    return [
        0 if words[0] in gazetteer.given else -1,
        0 if re.match(rf"^(?:{_CAP}\.\s?)+", span) else -1,
        0 if any(w in NAME_CUES or w in TITLES for w in near[-2:]) else -1,
        1 if any(w in ORG_WORDS for w in [*words, *after[:2]]) else -1,
        1 if any(w in _STOP_WORDS for w in words[1:] if len(w) > 2) else -1,
        1 if span[0].islower() and not (near and (near[-1] in NAME_CUES or near[-1] in TITLES)) else -1,
    ]


def _shape(span: str) -> str:
    s = re.sub(r"\d+", lambda m: f"9{min(len(m[0]), 12)}", span)
    s = re.sub(r"[^\W\d_]+", lambda m: "A" if m[0].isupper() else "Aa" if m[0][0].isupper() else "a", s)
    return s[:40]


def features(family: str, text: str, a: int, b: int, vote: list[int]) -> list[int]:
    """Hashed features of a span."""
    before, after = _words_before(text, a, 2), _words_after(text, b, 2)
    named = [f"{family}|bias", f"{family}|shape|{_shape(text[a:b])}"]
    named += [f"{family}|v{i}|{v}" for i, v in enumerate(vote)]
    named += [f"{family}|b{i}|{w}" for i, w in enumerate(reversed(before))] + [f"{family}|a{i}|{w}" for i, w in enumerate(after)]
    return [xxhash.xxh32_intdigest(x) % DIMENSIONS for x in named]


def reconcile(patterns: dict[tuple[int, ...], int], n_classes: int, rounds: int = 30) -> dict[tuple[int, ...], np.ndarray]:
    """Probabilities of the classes for every vote pattern, by expectation-maximisation.

    Every labeller has a probability of each vote (abstaining included) given the
    class, started from being right four times in five and held near it by that
    many pseudo-counts.
    """
    if not patterns:
        return {}
    keys = list(patterns)
    votes_ = np.array(keys)
    count = np.array([patterns[k] for k in keys], dtype=float)
    n_labellers = votes_.shape[1]
    right, wrong = 0.8, 0.2 / max(1, n_classes - 1)
    prior_vote = np.full((n_labellers, n_classes, n_classes + 1), wrong)
    for c in range(n_classes):
        prior_vote[:, c, c] = right
    prior_vote[:, :, n_classes] = 1.0
    strength = max(10.0, 0.1 * count.sum())
    p_vote = prior_vote / prior_vote.sum(2, keepdims=True)
    p_class = np.full(n_classes, 1 / n_classes)
    at = np.where(votes_ < 0, n_classes, votes_)
    for _ in range(rounds):
        log = np.log(p_class)[None, :] + sum(np.log(p_vote[j, :, at[:, j]]) for j in range(n_labellers))
        post = np.exp(log - log.max(1, keepdims=True))
        post /= post.sum(1, keepdims=True)
        weight = post * count[:, None]
        p_class = (weight.sum(0) + 1) / (weight.sum() + n_classes)
        for j in range(n_labellers):
            seen = np.zeros((n_classes, n_classes + 1))
            for v in range(n_classes + 1):
                seen[:, v] = weight[at[:, j] == v].sum(0)
            seen += strength * prior_vote[j] / prior_vote[j].sum(1, keepdims=True)
            p_vote[j] = seen / seen.sum(1, keepdims=True)
    return dict(zip(keys, post))


def train(rows: list[tuple[list[int], np.ndarray]], n_classes: int, rounds: int = 60) -> np.ndarray:
    """Weights (features, classes) of a logistic classifier fitted to class probabilities."""
    weights = np.zeros((DIMENSIONS, n_classes))
    if not rows:
        return weights
    sizes = [len(f) for f, _ in rows]
    index, of = np.concatenate([f for f, _ in rows]), np.repeat(np.arange(len(rows)), sizes)
    wanted = np.array([p for _, p in rows])
    square = np.zeros((DIMENSIONS, n_classes)) + 1e-8
    for _ in range(rounds):
        z = np.zeros_like(wanted)
        np.add.at(z, of, weights[index])
        z = np.exp(z - z.max(1, keepdims=True))
        z /= z.sum(1, keepdims=True)
        gradient = np.zeros_like(weights)
        np.add.at(gradient, index, (z - wanted)[of])
        gradient = gradient / len(rows) + 1e-5 * weights
        square += gradient * gradient
        weights -= 0.5 * gradient / np.sqrt(square)
    return weights


_SPANS = "family string, start_pos int, end_pos int, pii_text string, votes array<int>, features array<int>"


def _proposer(given: frozenset[str]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gazetteer = Gazetteer(given)
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                rows: list[tuple] = []
                for n, text in enumerate(part.column(part.num_columns - 1).to_pylist()):
                    for family, a, b in proposals(text, gazetteer):
                        v = votes(family, text, a, b, gazetteer)
                        rows.append((n, family, a, b, text[a:b], v, features(family, text, a, b, v)))
                if not rows:
                    continue
                columns = list(zip(*rows))
                kept = [c.take(pa.array(columns[0], pa.int64())) for c in part.columns[:-1]]
                types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays(
                    [*kept, *[pa.array(c, t) for c, t in zip(columns[1:], types)]], names=[*part.schema.names[:-1], "family", "start_pos", "end_pos", "pii_text", "votes", "features"]
                )

    return work


def spans(df: DataFrame, text_col: str, *keep: str, given: Iterable[str] = ()) -> DataFrame:
    """One row per proposed span: ``keep``, its family, offsets, text, votes and features."""
    rows = df.select(*keep, F.col(text_col).alias("__text")).where(F.col("__text").isNotNull())
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_proposer(frozenset(given)), kept + _SPANS)


def fit(proposed: DataFrame, *keep: str) -> dict[str, np.ndarray]:
    """The final classifier of each family. The driver gets counts of vote patterns and at most TRAIN_SPANS spans.

    Spans are picked by a hash of their row's ``keep`` and their place in it, so equal spans of one template do not enter together.
    """
    patterns: dict[str, dict[tuple[int, ...], int]] = {f: {} for f in CLASSES}
    for r in proposed.groupBy("family", "votes").agg(F.count(F.lit(1)).alias("n")).collect():
        patterns[r.family][tuple(r.votes)] = r.n
    truth = {f: reconcile(p, len(CLASSES[f])) for f, p in patterns.items()}
    rows = proposed.select("family", "votes", "features", F.struct(*keep, "pii_text", "start_pos").alias("place"))
    sample = hashed_sample(rows, F.col("place"), proposed.count(), TRAIN_SPANS).select("family", "votes", "features").collect()
    return {f: train([(r.features, truth[f][tuple(r.votes)]) for r in sample if r.family == f], len(CLASSES[f])) for f in CLASSES}


def _decider(shared):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            family = batch.column(batch.schema.get_field_index("family")).to_pylist()
            feature = batch.column(batch.schema.get_field_index("features")).to_pylist()
            kinds = []
            for f, x in zip(family, feature):
                score = weights[f][x].sum(0)
                kinds.append(CLASSES[f][int(score.argmax())])
            kept = [c for c, n in zip(batch.columns, batch.schema.names) if n not in ("family", "votes", "features")]
            names = [n for n in batch.schema.names if n not in ("family", "votes", "features")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(kinds, pa.string())], names=[*names, "pii_kind"])

    return work


def personal_items(df: DataFrame, text_col: str, *keep: str, given: Iterable[str] = (), label: str = "pii") -> DataFrame:
    """One row per item found: ``keep``, ``start_pos``, ``end_pos``, ``pii_text`` (exactly as written), ``pii_kind``.

    Kinds: email, phone, id_number, address, person_name. Offsets are code points,
    the end exclusive. Null texts have no items; rows met repeatedly give theirs as
    often; a table without texts gives none. Texts are used whole. ``keep`` may not
    contain the names made here. ``given`` adds given names to the gazetteer.
    """
    proposed = Scratch(df.sparkSession, label).save(spans(df, text_col, *keep, given=given))
    shared = df.sparkSession.sparkContext.broadcast(fit(proposed, *keep))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in proposed.schema.fields if f.name in keep)
    return proposed.mapInArrow(_decider(shared), kept + "start_pos int, end_pos int, pii_text string, pii_kind string").where("pii_kind <> ''")


def redacted(df: DataFrame, text_col: str, *keep: str, given: Iterable[str] = (), label: str = "redact") -> DataFrame:
    """``keep`` and the text with every item replaced by its typed placeholder; texts without items are unchanged.

    The classifier is fitted on the spans of all rows first; each text is then
    searched again where it is read, so no text is shuffled.
    """
    known = frozenset(given)
    proposed = Scratch(df.sparkSession, label).save(spans(df, text_col, *keep, given=known))
    shared = df.sparkSession.sparkContext.broadcast(fit(proposed, *keep))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gazetteer, weights = Gazetteer(known), shared.value
        for batch in batches:
            out = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                for family, a, b in sorted(proposals(text, gazetteer), key=lambda x: -x[1]) if text else ():
                    x = features(family, text, a, b, votes(family, text, a, b, gazetteer))
                    kind = CLASSES[family][int(weights[family][x].sum(0).argmax())]
                    if kind:
                        text = text[:a] + PLACEHOLDER[kind] + text[b:]
                out.append(text)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.string())], names=[*batch.schema.names[:-1], "redacted"])

    rows = df.select(*keep, F.col(text_col).alias("__text"))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(work, kept + "redacted string")
