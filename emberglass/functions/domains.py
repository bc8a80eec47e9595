"""Domain suffixes and phone prefixes, as column expressions over small fixed tables.

The tables are reduced: generic and country suffixes with the common second-level ones, and the calling codes of the larger countries.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes of one label.
SUFFIXES = (
    "com org net edu gov mil int info biz name io co ai app dev xyz online site shop store tech club live me tv cc us uk de fr es it nl be at ch se no dk fi pl cz sk hu ro bg gr pt ie ru ua by kz tr il ae sa eg za ng ke ma in pk bd lk "
    "cn jp kr tw hk sg my th vn id ph au nz ca mx br ar cl pe ve ec uy is lt lv ee si hr rs lu eu asia cloud blog news wiki"
).split()
#: Suffixes of two labels.
SECOND = "co.uk org.uk ac.uk gov.uk me.uk com.au net.au org.au edu.au co.nz org.nz co.jp ne.jp or.jp ac.jp co.kr or.kr com.br net.br org.br com.mx com.ar com.tr com.cn net.cn org.cn com.tw com.hk com.sg com.my co.in net.in org.in co.za org.za co.il com.ua com.pl com.eg com.sa com.ng co.ke co.id com.ph com.vn co.th".split()
#: Calling code to country.
CALLING = dict(
    x.split(":")
    for x in (
        "1:US 1204:CA 1226:CA 1236:CA 1249:CA 1250:CA 1289:CA 1306:CA 1343:CA 1365:CA 1403:CA 1416:CA 1418:CA 1431:CA 1437:CA 1438:CA 1450:CA 1506:CA 1514:CA 1519:CA 1581:CA 1587:CA 1604:CA 1613:CA 1647:CA 1705:CA 1709:CA 1778:CA 1780:CA "
        "1807:CA 1819:CA 1867:CA 1902:CA 1905:CA 1787:PR 1939:PR 1809:DO 1829:DO 1876:JM 7:RU 77:KZ 20:EG 27:ZA 30:GR 31:NL 32:BE 33:FR 34:ES 36:HU 39:IT 40:RO 41:CH 43:AT 44:GB 45:DK 46:SE 47:NO 48:PL 49:DE 51:PE 52:MX 53:CU 54:AR 55:BR "
        "56:CL 57:CO 58:VE 60:MY 61:AU 62:ID 63:PH 64:NZ 65:SG 66:TH 81:JP 82:KR 84:VN 86:CN 90:TR 91:IN 92:PK 93:AF 94:LK 95:MM 98:IR 212:MA 213:DZ 216:TN 234:NG 254:KE 351:PT 352:LU 353:IE 354:IS 358:FI 359:BG 370:LT 371:LV 372:EE 380:UA "
        "381:RS 385:HR 386:SI 420:CZ 421:SK 852:HK 880:BD 886:TW 961:LB 962:JO 964:IQ 965:KW 966:SA 971:AE 972:IL 974:QA"
    ).split()
)


def _last(host: Column, n: int) -> Column:
    return F.substring_index(host, ".", -n)


def suffix(host: Column) -> Column:
    """The public suffix of a host in lower case; null where it is unknown or all there is."""
    return F.when(_last(host, 2).isin(SECOND) & (_last(host, 2) != host), _last(host, 2)).when(_last(host, 1).isin(SUFFIXES) & host.contains(".") & ~host.isin(SECOND), _last(host, 1))


def registrable(host: Column) -> Column:
    """The suffix with the label before it."""
    s = suffix(host)
    return F.when(s.contains("."), _last(host, 3)).when(s.isNotNull(), _last(host, 2))


def phone_country(number: Column) -> Column:
    """Country of a number written with a plus sign, by its longest known calling code."""
    digits = F.regexp_replace(number, r"[^0-9]", "")
    table = F.create_map(*[F.lit(x) for kv in CALLING.items() for x in kv])
    found = F.coalesce(*[F.when(F.length(digits) > n, F.try_element_at(table, F.substring(digits, 1, n))) for n in (4, 3, 2, 1)])
    return F.when(number.rlike(r"^\s*\+\s*[1-9][0-9 ().\-]{5,}$"), found)
