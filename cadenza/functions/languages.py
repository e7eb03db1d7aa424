"""Language codes of names and streams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two-letter language codes with the three letters of their terminological code.
ALPHA3 = """aa aar ab abk ae ave af afr ak aka am amh an arg ar ara as asm av ava ay aym az aze ba bak be bel bg bul bi bis bm bam bn ben bo bod br bre bs bos
ca cat ce che ch cha co cos cr cre cs ces cu chu cv chv cy cym da dan de deu dv div dz dzo ee ewe el ell en eng eo epo es spa et est eu eus
fa fas ff ful fi fin fj fij fo fao fr fra fy fry ga gle gd gla gl glg gn grn gu guj gv glv ha hau he heb hi hin ho hmo hr hrv ht hat hu hun hy hye hz her
ia ina id ind ie ile ig ibo ii iii ik ipk io ido is isl it ita iu iku ja jpn jv jav ka kat kg kon ki kik kj kua kk kaz kl kal km khm kn kan ko kor kr kau ks kas ku kur kv kom kw cor ky kir
la lat lb ltz lg lug li lim ln lin lo lao lt lit lu lub lv lav mg mlg mh mah mi mri mk mkd ml mal mn mon mr mar ms msa mt mlt my mya
na nau nb nob nd nde ne nep ng ndo nl nld nn nno no nor nr nbl nv nav ny nya oc oci oj oji om orm or ori os oss pa pan pi pli pl pol ps pus pt por qu que
rm roh rn run ro ron ru rus rw kin sa san sc srd sd snd se sme sg sag si sin sk slk sl slv sm smo sn sna so som sq sqi sr srp ss ssw st sot su sun sv swe sw swa
ta tam te tel tg tgk th tha ti tir tk tuk tl tgl tn tsn to ton tr tur ts tso tt tat tw twi ty tah ug uig uk ukr ur urd uz uzb ve ven vi vie vo vol wa wln wo wol xh xho yi yid yo yor za zha zh zho zu zul"""
#: Bibliographic codes with their terminological ones.
BIBLIOGRAPHIC = """alb sqi arm hye baq eus bur mya chi zho cze ces dut nld fre fra ger deu gre ell ice isl mac mkd mao mri may msa per fas rum ron slo slk tib bod wel cym"""


def pairs(text: str) -> list[tuple[str, str]]:
    words = text.split()
    return list(zip(words[::2], words[1::2]))


def _of(table: str, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in pairs(table) for x in pair]), key)


def normalize_language(code: Column) -> Column:
    """The three-letter code of a language tag's first part; null for none, another length, or unknown two letters."""
    first = F.element_at(F.split(F.replace(F.lower(F.btrim(code)), F.lit("_"), F.lit("-")), "-"), 1)
    return F.when(F.length(first) == 2, _of(ALPHA3, first)).when(F.length(first) == 3, F.coalesce(_of(BIBLIOGRAPHIC, first), first))


def subtitle_language(name: Column) -> Column:
    """The known language that the end of a file name's stem tells, in three letters, else null."""
    stem = F.regexp_replace(F.regexp_extract(name, r"[^/]*$", 0), r"(?<=.)\.[^.]*$", "")
    code = normalize_language(F.regexp_extract(stem, r"\.([a-zA-Z]{2,3})$", 1))
    return F.when(code.isin([b for _, b in pairs(ALPHA3)]), code)


def language_list(codes: Column) -> Column:
    """An array of codes as one list: trimmed, upper case, the first of equal ones."""
    some = F.filter(F.transform(codes, lambda x: F.btrim(x)), lambda x: x.isNotNull() & (x != ""))
    return F.array_join(F.array_distinct(F.transform(some, lambda x: F.upper(F.replace(x, F.lit("-"), F.lit("_"))))), ",")
