"""Sentence units of texts in many languages and scripts, in SQL expressions only.

Points that end nothing (decimals, addresses, initials, abbreviations, ordinals, ellipses, marks
inside a quotation the sentence goes on behind) are masked by a private-use character, one for
one, so positions stay; then boundaries are set behind the end marks of each script, and the
original text is cut at those positions, which restores it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK, OPEN, CLOSE, CLOSE_JA, CUT = "", "", "", "", ""

#: Abbreviations whose point never ends a sentence (single letters are handled by rule).
ABBREVIATIONS = {
    "en": "Mr Mrs Ms Dr Prof Rev Gen Col Capt Lt Sgt Hon St Mt Messrs Sr No Nos Fig Figs fig figs Sec Secs sec Ch ch Eq eq "
    "Vol vol pp ed eds cf vs viz approx Approx est resp al dept Dept Univ Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec ver Ver Ref ref",
    "de": "Hr Fr Frl Nr Nrn Abb Abschn Abs Anm Art Aufl Bd Bsp Kap Tab Tel Str bzw bspw ca evtl ggf inkl exkl max min Max Min mind "
    "sog usf vgl Vgl zzgl zus zz Dipl Ing Jh Jhd Std Sek geb gest Zl",
    "fr": "MM Mlle Mgr Me env av apr chap Chap fasc art ex éd tél boul quest réf req Sté voy",
    "es": "Sra Srta Sres Dra Dras Ud Uds Vd pág págs Pág núm núms Núm cap art ej tel tels Avda Lic Ing Arq EE aprox Aprox máx mín",
    "ru": "стр рис Рис гл табл ок тыс млн млрд трлн руб коп см См ср Ср проф Проф акад доц ул пр им англ нем напр пер ред изд прим мин сек",
    "el": "δηλ κ κα κος σελ Σελ αρ Αρ κεφ εικ Εικ βλ Βλ καθ Καθ περ τηλ",
}
#: Abbreviations that may close a sentence; they do before a capital letter.
CLOSING = "etc usw uvm ff Inc Ltd Corp Co Jr Bros GmbH др пр κλπ κτλ mm cm km ms kg Uhr UU"
#: Words that begin a sentence behind a single capital letter ("plan B. The next").
STARTERS = "The It This That These Those There Then We He She They You In On At If When But And So A An Each Every No Der Die Das Es Le La Les El Los"
#: Words before a German ordinal ("am 3. Mai").
BEFORE_ORDINAL = "am Am den Den der Der dem Dem des Des vom Vom zum Zum im Im bis Bis ab Ab seit Seit beim Beim jeden Jeden und zur Zur ihrem seinem ihren seinen"

_LO_CUTTING = r"\p{Lo}\p{Lm}"
_CODE = rf"[a-z][\p{{L}}\p{{N}}-]*+(?:[0-9_(/:]|{MASK}[\p{{L}}\p{{N}}])|[a-z]++[A-Z0-9_(/]|`|[a-z]++:"
_NEXT = rf"[{OPEN}¿¡`*_]*+\s*+(?:[\p{{Lu}}\p{{Lt}}\p{{N}}{_LO_CUTTING}]|(?:{_CODE}))"
_LOWER = rf"(?!{_CODE})\p{{Ll}}"
_NO_MARKS = f"[^{OPEN}{CLOSE}{CLOSE_JA}{CUT}]"
#: End marks of all scripts.
_MARKS = ".!?…。！？｡．؟।۔။።;;"
_PARTICLE = r"と(?!ても|ころ)|の|を|に|が|へ|や|など|って|は(?!い)|も(?!う)|で(?!も|す)|から|まで|より|だと|なる|なの"
_ALWAYS = r"\p{IsHangul}\p{IsDevanagari}\p{IsArabic}\p{IsMyanmar}\p{IsKhmer}\p{IsEthiopic}\p{IsThai}"
#: What shows, behind a closing mark, that the sentence goes on.
_GOES_ON = rf"\s*+(?:{_LOWER}|[{_ALWAYS}]|[,;:，、；：.!?。！？؛،–—])"


def _words(*lists: str) -> str:
    return "|".join(sorted({w for x in lists for w in x.split()}, key=lambda w: (-len(w), w)))


def masked(text: Column) -> Column:
    """``text`` with blocks cut apart and points that end nothing masked; cuts are extra characters.

    Each pattern starts with the one or two characters it is about, so most positions fail at once.
    """
    sub = F.regexp_replace
    t = sub(text, "[\ue000-\ue0ff]", "\ufffd")
    # blocks: empty lines, and lines that start with a marker
    t = sub(t, r"\n[ \t\r]*(?=\n)", f"$0{CUT}")
    t = sub(t, rf"(?<![^\n{CUT}])[ \t\ufeff]*(?:[#*-]|\d+\.[ \t])[^\n]*", f"{CUT}$0{CUT}")
    t = sub(t, "[\t\n\x0b\f\r\u0085\u00a0\u2000-\u200a\u2028\u2029\u202f\u3000\ufeff]", " ")
    t = sub(t, rf"({CUT} *\d+)\.(?= )", f"$1{MASK}")
    # quotes and brackets by direction
    cjk, before = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]", rf"(?<![^\s(\[{CUT}].)"
    t = sub(t, rf"[\"“»«'‘](?:{before}(?:(?<=[\"“»])(?=\S)|(?<=«)|(?<=['‘])(?=\p{{L}}))|(?<=“)(?={cjk})|(?<={cjk}“)(?=\w))", OPEN)
    t = sub(t, "[„‚（(「『《〈【\\[]", OPEN)
    t = sub(t, "[\"“”»«)）》〉】\\]]|['’](?<=[.!?…].)", CLOSE)
    t = sub(t, "[」』]", CLOSE_JA)
    # decimals, versions, names, addresses; ellipses unless a capital follows
    t = sub(
        t,
        rf"[.?!．…](?:(?<=\.)(?=[\p{{L}}\p{{N}}_/\\-])|(?<=[?!])(?=[A-Za-z0-9=&/_])|(?<=[0-9０-９]．)(?=[0-9０-９])"
        rf"|(?:(?<=…)|(?<=\.)(?=\.)|(?<=\.\.))(?=[.…]*+[{CLOSE}{CLOSE_JA}]*+\s*+(?![{OPEN}¿¡]*+\s*+\p{{Lu}})))",
        MASK,
    )
    # shortened words
    word = rf"(?<![\p{{L}}\p{{M}}\p{{N}}{MASK}])"
    t = sub(t, rf"({word}(?=\p{{L}}{{2,8}}\.)(?:{_words(*ABBREVIATIONS.values())}))\.", f"$1{MASK}")
    # letters; shortened words and units that may close a sentence, before a capital, a number or a name
    may = rf"\s++(?:[{OPEN}¿¡]*+\s*+[\p{{Lu}}\p{{N}}]|(?:{_CODE}))"
    closing = rf"{word}(?:[ap]{MASK}m|[тТ](?:{MASK}|\. {{0,3}})[дп]|(?<=\d {{1,3}})\p{{Ll}}|(?:{_words(CLOSING)}))\."
    letters = rf"{word}[\p{{Lu}}\p{{Ll}}\p{{IsArabic}}](?:{MASK}\p{{L}}){{0,24}}\."
    t = sub(
        t,
        rf"\.(?:(?<={closing})(?!{may})|(?<={letters})(?<!{closing})(?!(?<=\p{{Lu}}\.)\s+(?:{_words(STARTERS)})\b)"
        rf"|(?= )(?<= \d{{1,2}}\.)(?<=\b(?:{_words(BEFORE_ORDINAL)}) {{1,3}}\d{{1,2}}\.)"
        rf"|(?<=[\p{{IsDevanagari}}\p{{IsMyanmar}}\p{{IsKhmer}}\p{{IsEthiopic}}]\.))",
        MASK,
    )
    # quotations, titles and brackets behind which the sentence goes on: from such an opening mark
    # on (or from the last mark masked), up to the next end mark before anything closes
    goes_on = rf"{CLOSE}(?:{_GOES_ON}|\s*+\p{{IsHan}}|(?:{_PARTICLE}))|{CLOSE_JA}(?:{_GOES_ON}|(?:{_PARTICLE}))"
    return sub(
        t,
        rf"((?:{OPEN}(?={_NO_MARKS}*+(?:{goes_on}))|\G(?!\A))[^{_MARKS}{OPEN}{CLOSE}{CLOSE_JA}{CUT}]*+)[{_MARKS}]",
        f"$1{MASK}",
    )


def cut(text: Column) -> Column:
    """``masked`` text with a cut behind every unit."""
    shut = rf"(?:\s{{0,3}}+[{CLOSE}{CLOSE_JA}])*+"
    t = F.regexp_replace(
        masked(text),
        rf"[.!?…]++{shut}(?=\s++{_NEXT})|[!?]++{shut}(?=[\p{{IsHan}}\p{{IsHiragana}}\p{{IsKatakana}}])"
        rf"|[。！？｡．؟।॥۔။។៕።፧፨]++[!?！？]*+[{CLOSE}{CLOSE_JA}]*+"
        rf"|[;;](?<=\p{{IsGreek}}.){shut}(?=\s++{_NEXT})",
        f"$0{CUT}",
    )
    thai, apart = r"[ก-๏๚-๿]", r"\s\p{IsLatin}\p{N}"
    return F.regexp_replace(t, rf"(?= )(?:(?<={thai})(?= ++[^{apart}])|(?<=[^{apart}#*{MASK}-])(?= ++{thai}))", CUT)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _over_chunks(pieces: Column, chunk: int, body) -> Column:
    """``body(pieces, start)`` of each chunk of pieces, in one array; ``start`` is the chunk's first position.

    Lengths are summed up within chunks of pieces and over chunks, so very long texts stay cheap.
    """
    zero, none = F.lit(0).cast("bigint"), F.array().cast("array<bigint>")

    def starts(chunks: Column) -> Column:
        sizes = F.transform(chunks, lambda c: F.aggregate(c, zero, lambda s, p: s + F.length(p)))
        return F.aggregate(
            sizes,
            F.struct(zero.alias("at"), none.alias("starts")),
            lambda s, n: F.struct((s["at"] + n).alias("at"), F.array_append(s["starts"], s["at"]).alias("starts")),
        )["starts"]

    def chunks(pieces: Column) -> Column:
        last = F.floor((F.size(pieces) - 1) / chunk).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(pieces, i * chunk + 1, F.lit(chunk)))

    return _let(_let(pieces, chunks), lambda c: F.flatten(F.zip_with(c, starts(c), body)))


def _fold(pieces: Column, start: Column, kind: str, unit) -> Column:
    """An array with ``unit(at, piece)`` of each piece that isn't blank; ``at`` is the piece's position."""
    return F.aggregate(
        pieces,
        F.struct(start.alias("at"), F.array().cast(f"array<{kind}>").alias("out")),
        lambda s, p: F.struct(
            (s["at"] + F.length(p)).alias("at"), F.when(F.length(F.btrim(p)) > 0, F.array_append(s["out"], unit(s["at"], p))).otherwise(s["out"]).alias("out")
        ),
    )["out"]


def unit_ends(text: Column, chunk: int = 256) -> Column:
    """The array of end positions (characters up to and with the unit's last one), in order."""
    ends = lambda pieces, start: _fold(pieces, start, "bigint", lambda at, p: at + F.length(F.rtrim(p)))
    return _over_chunks(F.split(cut(text), CUT), chunk, ends)


def units(text: Column, chunk: int = 64) -> Column:
    """The array of (end_char, unit), in order.

    Each unit is cut from its chunk of the text, and each chunk from the text, so a unit costs its
    chunk's length, not the text's.
    """

    def within(pieces: Column, start: Column) -> Column:
        size = F.aggregate(pieces, F.lit(0).cast("bigint"), lambda s, p: s + F.length(p))
        part = F.substring(text, start.cast("int") + 1, size.cast("int"))

        def unit(whole: Column):
            def one(at: Column, p: Column) -> Column:
                n = F.length(F.rtrim(p))
                raw = F.substring(whole, (at - start + 1).cast("int"), n)
                return F.struct((at + n).alias("end_char"), F.regexp_replace(raw, r"^[\s﻿ 　]+", "").alias("unit"))

            return one

        return _let(part, lambda whole: _fold(pieces, start, "struct<end_char:bigint,unit:string>", unit(whole)))

    return _over_chunks(F.split(cut(text), CUT), chunk, within)


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, unit_no, start_char, end_char, unit): one row per sentence unit of every text.

    Null, empty and blank texts give no rows; ids may repeat (each row is split for itself).  A
    row's work depends on its own text only, so nothing is shuffled; whole texts are read.
    """
    u = docs.select(F.col(id_col).alias(id_col), F.posexplode(units(F.col(text_col))).alias("unit_no", "u"))
    end, unit = F.col("u.end_char"), F.col("u.unit")
    return u.select(id_col, "unit_no", (end - F.length(unit)).alias("start_char"), end.alias("end_char"), unit.alias("unit"))


def sentence_ends(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, end_char) of ``sentences``, without the texts."""
    return docs.select(id_col, F.explode(unit_ends(F.col(text_col))).alias("end_char"))
