"""Personal data in texts: spans, masks, redaction and consistent pseudonyms."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import checks as C


@dataclass(frozen=True)
class Kind:
    """A kind of personal data: its pattern (the first group, if there is one, is the value), check and mask.

    need: literals in small letters, one of which every hit has. digits: so many decimal digits, of any script, stand in a row
    in every hit. near: a pattern that is found in every hit. default: a kind that is on unless it is left out. locale: the
    language of the texts that it is meant for.
    """

    name: str
    pattern: str
    ignore_case: bool = False
    check: object = None
    mask: object = None
    need: tuple[str, ...] = ()
    digits: int = 0
    near: str | None = None
    default: bool = False
    locale: str | None = None


# Patterns that tell personal data.
_IP = r"(?:25[0-5]|2[0-4]\d|[01]?\d?\d)"
KINDS = (
    Kind("tw_id", r"\b[A-Z][12]\d{8}\b", check=C.tw_id, mask=lambda v: C.keep_edges(v, 2, 2)),
    Kind("tw_arc", r"\b[A-Z][A-D89]\d{8}\b", check=C.tw_residence, mask=lambda v: C.keep_edges(v, 2, 2)),
    Kind("tw_biz", r"(?<!\d)\d{8}(?!\d)", check=C.tw_business, mask=lambda v: C.keep_edges(v, 2, 2)),
    Kind("mobile", r"(?:\+?886[\s\-]?|0)9\d{2}[\s\-．\.]?\d{3}[\s\-．\.]?\d{3}\b", mask=lambda v: C.mask_digits(v, 4, 3)),
    Kind("email", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", mask=C.mask_email),
    Kind("cc", r"\b(?:\d[ \-]?){13,19}\b", check=C.card, mask=C.mask_card),
    Kind("ip", rf"\b(?:{_IP}\.){{3}}{_IP}\b", mask=C.mask_ip),
    Kind("us_ssn", r"(?<![\d-])(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])", mask=lambda v: C.mask_digits(v, 0, 4)),
    Kind("mac", r"\b(?:[0-9A-Fa-f]{2}[:\-]){5}[0-9A-Fa-f]{2}\b", mask=lambda v: C.keep_edges(v, 2, 2)),
    Kind("uuid", r"\{?[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\}?", mask=lambda v: C.keep_edges(v, 4, 4)),
    Kind("tw_einvoice", r"\b[A-Z]{2}[ \-]?\d{8}\b", mask=lambda v: C.keep_edges(v, 2, 2)),
    Kind("flight", r"(?<![A-Z0-9])[A-Z]{2,3}\d{3,4}[A-Z]?(?![A-Z0-9])", mask=lambda v: C.keep_edges(v, 2, 1)),
    Kind("vin", r"\b[A-HJ-NPR-Z0-9]{17}\b", mask=lambda v: C.keep_edges(v, 3, 2)),
    Kind("order_num", r"\b(?:PO|SO|PR|INV|QT|WO|RMA|DO|DN|CN)[\-_/]?\d{2,4}(?:[\-_/]?[A-Z0-9]{1,8}){0,3}\b", ignore_case=True, mask=lambda v: C.keep_edges(v, 2, 2)),
    Kind("url_any", r"https?://[a-zA-Z0-9\-._~:/?#\[\]@!$&'()*+,;=%]+", mask=lambda v: C.keep_edges(v, 8, 0)),
    Kind("win_user", r"\b[A-Za-z][A-Za-z0-9\-]{1,30}\\[A-Za-z][A-Za-z0-9\-_.]{1,40}\b", mask=lambda v: C.keep_edges(v, 2, 2)),
    Kind("hash_value", r"\b[a-fA-F0-9]{32}\b|\b[a-fA-F0-9]{40}\b|\b[a-fA-F0-9]{56}\b|\b[a-fA-F0-9]{64}\b|\b[a-fA-F0-9]{96}\b|\b[a-fA-F0-9]{128}\b|\$2[aby]\$\d{2}\$[A-Za-z0-9./]{53}", mask=lambda v: C.keep_edges(v, 4, 4)),
    Kind("pem_block", r"-----BEGIN [A-Z0-9 ]+-----[\s\S]+?-----END [A-Z0-9 ]+-----", mask=lambda v: F.lit("[PEM-BLOCK-REDACTED]")),
    Kind("ssh_pubkey", r"\b(?:ssh-rsa|ssh-ed25519|ssh-dss|ssh-dsa|ecdsa-sha2-nistp(?:256|384|521)|sk-ssh-ed25519@openssh\.com|sk-ecdsa-sha2-nistp256@openssh\.com)\s+[A-Za-z0-9+/=]{20,}(?:\s+\S+)?", mask=lambda v: F.concat(F.regexp_extract(v, r"^\S*", 0), F.lit(" [SSH-PUBKEY-REDACTED]"))),
    Kind("cred_label", r"(?:password|passwd|pwd|secret|api[_-]?key|token|帳號|密碼|使用者名稱|登入帳號|登入密碼|金鑰|憑證)\s*[:：=]\s*(\S+)", ignore_case=True, mask=lambda v: C.keep_edges(v, 0, 0)),
    Kind("passport", r"(?:護照(?:號碼?)?|Passport(?:\s*No\.?|\s*Number)?)\s*[:：]?\s*([A-Z0-9]{8,10})\b", ignore_case=True, mask=lambda v: C.keep_edges(v, 2, 2)),
    Kind("bank_account", r"(?:公司帳[戶號]|銀行帳[戶號]|帳[戶號]號碼|帳[戶號]|Account\s*(?:No\.?|Number)?|A/?C)\s*[:：＝=]?\s*([0-9][0-9\-\s]{7,25}[0-9])", ignore_case=True, check=C.bank_account, mask=lambda v: C.mask_digits(v, 2, 2)),
    Kind("bank_code", r"(?:銀行代[碼號]|銀行別|Bank\s*Code)\s*[:：]?\s*(\d{3})", ignore_case=True, mask=lambda v: F.lit("***")),
    Kind("pnr", r"(?:PNR|Booking\s*(?:Ref(?:erence)?)?(?:\s*No\.?)?|Confirmation\s*(?:Code|Number|No\.?)?|訂位代號|訂位編號|代號)\s*[:：]?\s*([A-Z0-9]{6})\b", ignore_case=True, mask=lambda v: C.keep_edges(v, 1, 1)),
    Kind("iban", r"(?<![A-Z0-9])[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Z0-9])", check=C.iban, mask=lambda v: C.keep_edges(v, 4, 4)),
    Kind("hic", r"\b0000\d{8,12}\b", mask=lambda v: C.keep_edges(v, 4, 2)),
)

def _phone(v: Column) -> Column:
    return F.when(F.size(F.regexp_extract_all(v, F.lit(r"\d"), F.lit(0))) >= 10, C.mask_digits(v, 4, 3)).otherwise(C.mask_digits(v, 2, 2))


def _postcode(v: Column) -> Column:
    return F.concat(F.left(F.trim(v), F.lit(2)), F.repeat(F.lit("*"), F.greatest(F.length(F.trim(v)) - 2, F.lit(1))))


def _edges(head: int, tail: int):
    return lambda v: C.keep_edges(v, head, tail)


def _fixed(text: str):
    return lambda v: F.lit(text)


# Parts of the patterns below. Blanks are those of one line; hyphens are all that look like one.
_BLANK, _DASH = r"[^\S\n]", r"[\-\u2010-\u2015\u2212\u30fc\uff0d]"
_APART = r"[0-9\-\u2010-\u2015\u2212\u30fc\uff0d]"
_MONTH = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:t|tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
_STREET = r"(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Circle|Cir|Place|Pl|Terrace|Ter|Way|Highway|Hwy|Parkway|Pkwy|Square|Sq)"
_STATE = r"(?:AL|AK|AZ|AR|CA|CO|CT|DE|FL|GA|HI|ID|IL|IN|IA|KS|KY|LA|ME|MD|MA|MI|MN|MS|MO|MT|NE|NV|NH|NJ|NM|NY|NC|ND|OH|OK|OR|PA|RI|SC|SD|TN|TX|UT|VT|VA|WA|WV|WI|WY|DC)"
_INNER_NAMES = ("local", "internal", "corp", "lan", "intra", "intranet", "dev", "test", "staging", "prod", "private", "home", "domain", "ad", "company", "office")
_INNER = f"(?:{'|'.join(_INNER_NAMES)})"
_KEN = "青森|岩手|宮城|秋田|山形|福島|茨城|栃木|群馬|埼玉|千葉|神奈川|新潟|富山|石川|福井|山梨|長野|岐阜|静岡|愛知|三重|滋賀|兵庫|奈良|和歌山|鳥取|島根|岡山|広島|山口|徳島|香川|愛媛|高知|福岡|佐賀|長崎|熊本|大分|宮崎|鹿児島|沖縄"
# Further patterns that tell personal data.
MORE = (
    Kind("landline", r"(?:\(?\+?886\)?[\s\-]?|\b)0?[2-8][\s\-．\.]?\d{3,4}[\s\-．\.]?\d{3,4}(?:[\s\-]?(?:#|ext\.?|分機)[\s\-]?\d{1,5})?\b", True, mask=_phone, default=True, locale="zh"),
    Kind("driver_license", r"(?:駕照(?:號碼?)?|Driver(?:'s)?\s*License(?:\s*No\.?)?|DL\s*No\.?)\s*[:：]?\s*([A-Z0-9]{6,12})\b", True, mask=_edges(2, 2), need=("駕照", "license", "dl"), default=True),
    Kind(
        "dob",
        r"(?:出生(?:日期|年月日)?|生日|Date\s*of\s*Birth|DOB|Birth\s*Date)\s*[:：]?\s*((?:民國|西元)?\s*\d{2,4}\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日?|\d{4}\s*[\-/.]\s*\d{1,2}\s*[\-/.]\s*\d{1,2}|\d{1,2}\s*[\-/.]\s*\d{1,2}\s*[\-/.]\s*\d{4}"
        r"|(?:民國\s*)?\d{2,3}\s*[\-/.]\s*\d{1,2}\s*[\-/.]\s*\d{1,2}|\d{7,8})",
        True, mask=_fixed("****-**-**"), need=("出生", "生日", "birth", "dob"), default=True,
    ),
    Kind(
        "addr",
        r"(?:[台臺][北中南東]市|[一-鿿]{1,5}[縣市][一-鿿]{1,3}[區鄉鎮市])[一-鿿]{0,30}(?:[路街道]|大道)(?:[一-鿿]{0,5}段)?(?:[一-鿿\d]|[^\S\n]){0,20}\d+[^\S\n]*號(?:之\d+)?(?:[^\S\n]*[一-鿿\d]{0,5}[^\S\n]*樓)?(?:之\d+)?"
        r"|\bNo\.?\s*\d+[\s,]*(?:Sec\.?\s*\d+[\s,]*)?[A-Za-z][A-Za-z\s\-\.]{2,30}(?:\s*Rd\.?|\s*Road|\s*St\.?|\s*Street|\s*Ave\.?|\s*Avenue|\s*Lane|\s*Alley)(?:[\s,]*Floor\s*\d+|\s*\d+F\.?)?",
        True, mask=C.mask_address, need=("號", "no"), default=True, locale="zh",
    ),
    Kind("bank_branch", r"(?:銀行分行代?[碼號]?|分行代[碼號]|Branch\s*Code)\s*[:：]?\s*(\d{4,7})", True, mask=_fixed("***"), need=("分行", "branch")),
    Kind("account_name", r"(?:帳[戶號]名稱|戶名|Account\s*Name)\s*[:：]\s*([一-鿿\w\s\-·&．\.\(\)（）]{2,40}?)(?=\s*(?:$|[,，;；]|電話|統編|地址|Tel|Phone))", True, mask=_fixed("OOOO 有限公司"), need=("名稱", "戶名", "account"), default=True),
    Kind(
        "company",
        r"([一-鿿A-Za-z0-9·&\-\.．]{2,30}?(?:股份有限公司|有限公司|股份公司|有限責任公司|企業社|工作室|商行|事業處)"
        r"|\b(?:[A-Z][A-Za-z0-9&.\-]*)(?:\s+[A-Z][A-Za-z0-9&.\-]*){0,5}\s*,?\s*(?:Co\.\s*,?\s*Ltd\.?|Co\.,Ltd\.?|Inc\.?|L\.?L\.?C\.?|Corp(?:oration)?\.?|Limited|Company)(?=[^A-Za-z0-9]|$))",
        mask=_fixed("OOOO 有限公司"), need=("公司", "企業社", "工作室", "商行", "事業處", "co.", "inc", "llc", "l.lc", "ll.c", "l.l.c", "corp", "limited", "company"),
    ),
    Kind(
        "person_name",
        r"(?:姓名|聯絡人|負責人|申請人|承辦人|代表人|經手人|收件人|寄件人|業務員?|銷售人員|(?i:Name|Contact(?:\s*Person)?|Owner|Manager|Applicant|Responsible|Person\s*in\s*Charge|Sales(?:\s*Rep(?:resentative)?)?|Signed\s*by))"
        r"\s*[:：]?\s*([一-鿿]{2,4}(?![一-鿿])|[A-Z][A-Za-z.\-']{1,20}(?:[ ][A-Z][A-Za-z.\-']{1,20}){1,3})",
        mask=C.mask_name, need=("姓名", "人", "業務", "name", "contact", "owner", "manager", "applicant", "responsible", "person", "sales", "signed"),
    ),
    Kind("us_ssn_label", r"(?i:SSN|Social\s*Security(?:\s*(?:Number|No\.?|#))?)\s*[:：]?\s*((?!000|666|9\d\d)\d{3}[-\s]?(?!00)\d{2}[-\s]?(?!0000)\d{4})(?!\d)", mask=_edges(2, 2), need=("ssn", "social"), default=True, locale="en"),
    Kind("uk_ni", r"(?<![A-Z0-9])(?!BG|GB|NK|KN|TN|NT|ZZ)[ABCEGHJ-PRSTW-Z][ABCEGHJ-NPRSTW-Z]\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D](?![A-Z0-9])", check=C.uk_insurance, mask=_edges(2, 2), default=True, locale="en"),
    Kind("dob_en", rf"(?i:Date\s*of\s*Birth|DOB|Birth\s*Date|Born)\s*[:：]?\s*((?:{_MONTH}\.?\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{4}})|(?:\d{{1,2}}(?:st|nd|rd|th)?\s+{_MONTH}\.?,?\s+\d{{4}}))", True, mask=_edges(2, 2), need=("birth", "dob", "born"), default=True, locale="en"),
    Kind("nanp_phone", r"(?<![\d-])(?:\+?1[\s.\-]?)?(?:\([2-9]\d{2}\)|[2-9]\d{2})[\s.\-][2-9]\d{2}[\s.\-]\d{4}(?!\d)", check=C.us_phone, mask=_phone, default=True, locale="en"),
    Kind("uk_phone", r"(?<![\d+])(?:\+44\s?\(?0?\)?\s?|0)(?:\d{2,5}[\s-]?)(?:\d{3,4}[\s-]?)\d{3,4}(?!\d)", mask=_phone, default=True, locale="en"),
    Kind(
        "us_addr",
        rf"\b\d{{1,6}}[A-Za-z]?\s+(?:[A-Z][\w.'\-]*\s+){{1,4}}{_STREET}\b\.?(?:[,\s]+(?:Apt|Apartment|Suite|Ste|Unit|Rm|Room|Floor|Fl|#)\s*[\w\-]+)?(?:,\s*[A-Z][\w.'\- ]{{1,24}})?(?:,\s*{_STATE})?(?:\s+\d{{5}}(?:-\d{{4}})?)?",
        mask=C.mask_address, default=True, locale="en",
    ),
    Kind("uk_postcode", r"(?<![A-Z0-9])[A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2}(?![A-Z0-9])", True, mask=_postcode, locale="en"),
    Kind("jp_mynumber", rf"(?<!{_APART})\d{{4}}(?:{_BLANK}|{_DASH})?\d{{4}}(?:{_BLANK}|{_DASH})?\d{{4}}(?!{_APART})", check=C.jp_personal, mask=_edges(2, 2), default=True, locale="ja"),
    Kind("jp_corp_no", rf"(?<!{_APART})\d{{13}}(?!{_APART})", check=C.jp_corporate, mask=_edges(2, 2), default=True, locale="ja"),
    Kind("jp_phone", rf"(?<!{_APART})0\d{{1,4}}{_DASH}\d{{1,4}}{_DASH}\d{{3,4}}(?!{_APART})", mask=_phone, default=True, locale="ja"),
    Kind("jp_postcode", rf"〒{_BLANK}*\d{{3}}{_DASH}\d{{4}}", mask=_postcode, need=("〒",), default=True, locale="ja"),
    Kind(
        "jp_addr",
        rf"(?:北海道|東京都|京都府|大阪府|[^\S\n]{{0,2}}(?:{_KEN})県)[^\S\n]{{0,2}}[^\s、。]{{1,12}}?[市区町村郡](?:[^\s、。]{{0,20}}?[0-9０-９丁目番地号]|{_DASH}){{1,20}}",
        mask=lambda v: F.concat(F.regexp_extract(v, r"^(北海道|東京都|京都府|大阪府|[^\s]{2,4}県)?", 0), F.lit("〇〇市〇〇町〇-〇")), need=("北海道", "東京都", "京都府", "大阪府", "県"), default=True, locale="ja",
    ),
    Kind("jp_name", r"(?:氏名|名前|お名前|申請者|担当者)\s*[:：]?\s*([\u4e00-\u9fff]{1,5}[ \u3000][\u4e00-\u9fff]{1,5})", mask=C.mask_name, need=("氏名", "名前", "申請者", "担当者"), locale="ja"),
    Kind("jp_driver_license", rf"(?:運転免許証番号|運転免許番号|免許証番号|免許番号){_BLANK}*[:：]?{_BLANK}*(\d(?:{_BLANK}*\d){{11}})", mask=_edges(2, 2), need=("免許",), default=True, locale="ja"),
    Kind("jp_health_insurance", rf"(?:健康保険証|保険証|被保険者証)?{_BLANK}*記号{_BLANK}*[:：]?{_BLANK}*((?:[0-9A-Za-z]|{_DASH}){{2,12}})(?={_BLANK}*番号)", mask=_edges(2, 2), need=("記号",), default=True, locale="ja"),
    Kind("plate", r"(?:(?<=[車牌號照:：\s])|^)(?:[A-Z]{2,3}[\s\-]\d{3,4}|\d{3,4}[\s\-][A-Z]{2,3})(?=[\s,。、；;]|$)", mask=_edges(2, 1), locale="zh"),
    Kind(
        "gps",
        r"(?:(?<![\d.])[+\-]?(?:90(?:\.0+)?|[1-8]?\d\.\d{4,8})\s*[°]?\s*[NS]?\s*[,，]?\s*[+\-]?(?:180(?:\.0+)?|(?:1[0-7]\d|\d{1,2})\.\d{4,8})\s*[°]?\s*[EW]?"
        r"|\d{1,3}°\s*\d{1,2}['′]\s*[\d.]+[\"″]\s*[NS]\s*[,，]?\s*\d{1,3}°\s*\d{1,2}['′]\s*[\d.]+[\"″]\s*[EW])",
        mask=_fixed("[GPS-REDACTED]"),
    ),
    Kind("hostname", rf"\b(?=[a-z0-9])(?:[a-z0-9](?:[a-z0-9\-]{{0,61}}[a-z0-9])?\.){{2,}}(?:{'|'.join(_INNER_NAMES)}|[a-z]{{2,10}})\b", True, mask=_edges(2, 4), need=(".",)),
    Kind("ad_dn", r"\b(?:UID|CN|OU|DC|ST|[OLCE])=[^,\s]{1,128}(?:,\s*(?:UID|CN|OU|DC|ST|[OLCE])=[^,\s]{1,128}){1,30}\b", True, mask=_fixed("[AD-DN-REDACTED]"), need=("=",)),
    Kind("url_internal", rf"https?://(?:{_IP}(?:\.{_IP}){{3}}|[a-zA-Z0-9\-.]+\.{_INNER})(?::\d{{1,5}})?(?:/[^\s\"'<>]*)?", mask=_fixed("[INTERNAL-URL-REDACTED]"), need=("://",)),
    Kind("domain", r"\b(?<![@/])(?:[a-z0-9](?:[a-z0-9\-]{0,61}[a-z0-9])?\.)+[a-z]{2,24}\b(?![@/.])", True, mask=_edges(2, 4), need=(".",)),
    Kind(
        "user_path", r"(?:/home/|/Users/|C:\\Users\\|%USERPROFILE%\\?)(?:[A-Za-z][A-Za-z0-9._\-]{1,30})(?:[/\\][^\s\"'<>]*)?",
        mask=lambda v: F.regexp_replace(v, r"(/home/|/Users/|C:\\Users\\|%USERPROFILE%\\?)[^/\\]+", "$1USER"), need=("/home/", "/users/", "\\users\\", "%userprofile%"),
    ),
    # the first look-ahead is what the class asks for anyway; it spares the others, which read to the end of the line
    Kind(
        "api_token", r"\b(?=[A-Za-z0-9+/=_\-]{32})(?=.*[A-Z])(?=.*[a-z])(?=.*\d)[A-Za-z0-9+/=_\-]{32,}\b|\b(?:sk|pk|ghp|gho|ghs|ghu|ghr|github_pat|xox[bps]|AIza|AKIA|ASIA|hf_|hub_)[\-_][A-Za-z0-9_\-]{16,}\b", mask=_edges(4, 4)
    ),
    Kind("cred_pair", r"(?<![/\w@.])(?:[A-Za-z][A-Za-z0-9._\-]{2,30})\s*/\s*(?:[A-Za-z0-9!@#$%^&*._\-+=]{4,40})(?![/\w@.])", mask=_edges(1, 1), need=("/",)),
)
#: Those of the first list that are on unless they are left out, and those meant for texts of one language.
_DEFAULT = ("tw_id", "tw_arc", "passport", "mobile", "email", "cc", "bank_account", "tw_biz", "us_ssn", "iban")
_LOCALES = dict.fromkeys(("tw_id", "tw_arc", "hic", "mobile", "tw_biz", "tw_einvoice"), "zh") | dict.fromkeys(("us_ssn", "iban"), "en")
KINDS = tuple(replace(k, default=k.name in _DEFAULT, locale=_LOCALES.get(k.name)) for k in KINDS) + MORE

#: What every hit of a kind has, read off its pattern; most texts have none of it, and are not searched for that kind.
_DIGITS = {
    "tw_id": 8, "tw_arc": 8, "tw_biz": 8, "mobile": 3, "cc": 1, "ip": 1, "us_ssn": 4, "tw_einvoice": 8, "flight": 3, "order_num": 2, "bank_account": 1, "bank_code": 3, "iban": 2, "hic": 8,
    "landline": 3, "dob": 1, "addr": 1, "bank_branch": 4, "us_ssn_label": 3, "uk_ni": 2, "dob_en": 4, "nanp_phone": 4, "uk_phone": 3, "us_addr": 1, "uk_postcode": 1, "jp_mynumber": 4, "jp_corp_no": 13,
    "jp_phone": 3, "jp_postcode": 4, "jp_driver_license": 1, "plate": 3, "gps": 1,
}
_NEED = {
    "email": ("@",), "url_any": ("://",), "win_user": ("\\",), "pem_block": ("-----begin ",), "ssh_pubkey": ("ssh-", "ecdsa-"),
    "cred_label": ("password", "passwd", "pwd", "secret", "api", "token", "帳號", "密碼", "使用者名稱", "金鑰", "憑證"), "passport": ("護照", "passport"),
    "bank_account": ("帳", "ac", "a/c"), "bank_code": ("銀行", "bank"), "pnr": ("pnr", "booking", "confirmation", "訂位", "代號"),
}
_NEAR = {
    "mac": r"[0-9A-Fa-f]{2}[:\-][0-9A-Fa-f]{2}[:\-]", "uuid": r"-[0-9a-fA-F]{4}-", "hostname": r"\.\w", "domain": r"\.\w",
    "hash_value": r"[a-fA-F0-9]{32}|\$2[aby]\$", "api_token": r"[A-Za-z0-9+/=_\-]{19}",
}
KINDS = tuple(replace(k, need=k.need or _NEED.get(k.name, ()), digits=_DIGITS.get(k.name, 0), near=_NEAR.get(k.name)) for k in KINDS)
BY_NAME = {k.name: k for k in KINDS}


def defaults(language: str | None = None) -> list[Kind]:
    """Kinds that are on unless they are left out: of all languages, or those for texts of one (zh, en, ja)."""
    return [k for k in KINDS if k.default and (language is None or k.locale in (None, language))]


def chosen(names: Sequence[str] | None = None, custom: Sequence[tuple[str, str]] = ()) -> list[Kind]:
    """Kinds of the catalogue by name (None: all) and own (name, pattern) pairs; patterns that do not compile are skipped."""
    out = [k for k in KINDS if names is None or k.name in names]
    for name, pattern in custom:
        try:
            re.compile(pattern)
        except re.error:
            continue
        out.append(Kind(name, pattern, mask=lambda v: F.repeat(F.lit("*"), F.greatest(F.length(v), F.lit(1)))))
    return out


def counts(docs: DataFrame, names: Sequence[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, count of each kind), checks included, in JVM expressions only."""

    def found(k: Kind) -> Column:
        hits = F.regexp_extract_all(F.col(text_col), F.lit(("(?i)" if k.ignore_case else "") + k.pattern), F.lit(0))
        return F.size(F.filter(hits, k.check) if k.check else hits).cast("long")

    return docs.select(id_col, *(found(BY_NAME[n]).alias(n) for n in names))


def _slices(b: pa.RecordBatch, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows of about limit bytes."""
    rows = max(1, int(b.num_rows * limit / max(1, b.nbytes)))
    for lo in range(0, b.num_rows, rows):
        yield b.slice(lo, rows)


def _may(text: Column, kinds: Sequence[Kind]) -> Column:
    """A text may have a hit: false only if every kind asks for something that the JVM can tell that it lacks."""
    may = text.isNotNull()
    if all(k.digits or (k.need and all(x == x.upper() for x in k.need)) for k in kinds):  # letters have other forms than these
        some = [text.contains(x) for k in kinds if not k.digits for x in k.need]
        if any(k.digits for k in kinds):
            some.append(text.rlike(r"\p{Nd}"))
        may = may & functools.reduce(lambda a, b: a | b, some, F.lit(False))
    return may


def hits(docs: DataFrame, kinds: Sequence[Kind] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kind, start, end, value, masked, first, last) of every hit that passes its check; first and last are the ends of the whole match, start and end those of its value.

    Digits, letters and blanks are those of all scripts; digits are turned to 0-9 for the checks.
    """
    kinds = list(kinds or KINDS)
    ids = docs.schema[id_col].dataType.simpleString()
    patterns = [(k.name, k.need, k.digits, k.near and re.compile(k.near), re.compile(k.pattern, re.IGNORECASE if k.ignore_case else 0)) for k in kinds]
    number = re.compile(r"\d+")

    def plain(value: str) -> str:
        return value if value.isascii() else "".join(str(unicodedata.decimal(c)) if c.isdecimal() else c for c in value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _slices(whole):
                at, out = [], []
                for i, text in enumerate(b.column(1).to_pylist()):
                    small = text.casefold().replace("ı", "i").replace("\u0307", "")  # as patterns see letters without case
                    row = max(map(len, number.findall(text)), default=0)
                    for name, need, digits, near, p in patterns:
                        if digits > row or (need and not any(x in small for x in need)) or (near and not near.search(text)):
                            continue
                        for m in p.finditer(text):
                            g = 1 if p.groups and m.group(1) is not None else 0
                            at.append(i)
                            out.append((name, m.start(g), m.end(g), m.group(g), m.start(), m.end(), plain(m.group(g))))
                cols = list(zip(*out)) or [()] * 7
                types = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, types))], [id_col, "kind", "start", "end", "value", "first", "last", "plain"])

    raw = docs.select(id_col, text_col).filter(_may(F.col(text_col), kinds)).mapInArrow(run, f"`{id_col}` {ids}, kind string, start int, end int, value string, first int, last int, plain string")
    good, masked = F.lit(True), F.col("value")
    for k in kinds:
        if k.check:
            good = F.when(F.col("kind") == k.name, k.check(F.col("plain"))).otherwise(good)
        if k.mask:
            masked = F.when(F.col("kind") == k.name, k.mask(F.col("value"))).otherwise(masked)
    return raw.filter(good).select(id_col, "kind", "start", "end", "value", masked.alias("masked"), "first", "last")


def spans(docs: DataFrame, kinds: Sequence[Kind] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kind, start, end, value, masked) of every hit that passes its check; one inside a longer hit of its kind is left out.

    Offsets need the regular expressions of Python; null texts have no hits, and an empty table gives no rows.
    """
    w = Window.partitionBy(id_col, "kind").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    found = hits(docs, kinds, id_col, text_col).withColumn("_far", F.max("end").over(w))
    return found.filter(F.col("_far").isNull() | (F.col("_far") < F.col("end"))).select(id_col, "kind", "start", "end", "value", "masked")


def rewrite(docs: DataFrame, found: DataFrame, mode: str = "mask", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with their spans replaced by the mask, by blocks of the same length (redact), or by the column fake.

    Of a span that begins inside one that was replaced before, what stands out goes: as blocks or stars of its length.
    """
    new = {"mask": F.col("masked"), "redact": F.repeat(F.lit("█"), F.length("value"))}.get(mode, F.col("fake") if "fake" in found.columns else F.col("masked"))
    lists = found.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("start", (-F.col("end")).alias("minus"), new.alias("new")))).alias("_s"))  # the spans of one text
    both = docs.join(lists, id_col, "left")
    text = F.col(text_col)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    rest = F.lit("█" if mode == "redact" else "*")

    def step(a: Column, s: Column) -> Column:
        beyond = F.struct(F.concat(a["out"], F.repeat(rest, -s["minus"] - a["at"])).alias("out"), F.greatest(a["at"], -s["minus"]).alias("at"))
        return F.when(s["start"] < a["at"], beyond).otherwise(F.struct(F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), s["new"]).alias("out"), (-s["minus"]).alias("at")))

    done = F.aggregate("_s", start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.lit(1 << 30))))
    return both.withColumn(text_col, F.coalesce(done, text)).drop("_s")


def pseudonyms(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """found with fake: the same value of a kind is the same name in a document, numbered by first appearance."""
    firsts = found.groupBy(id_col, "kind", "value").agg(F.min("start").alias("_first"))
    n = F.row_number().over(Window.partitionBy(id_col, "kind").orderBy("_first", "value"))
    named = firsts.withColumn("fake", F.concat(F.lit("["), F.upper("kind"), F.lit("-"), n.cast("string"), F.lit("]"))).drop("_first")
    return found.join(named, [id_col, "kind", "value"])


def find_term(docs: DataFrame, term: str, case_sensitive: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start) of every occurrence of a literal term, those that overlap left out."""
    text, t = (F.col(text_col), term) if case_sensitive else (F.lower(text_col), term.lower())
    parts = F.split(text, re.escape(t).replace("\\ ", " "), -1)
    lengths = F.transform(F.slice(parts, 1, F.size(parts) - 1), F.length)
    starts = F.aggregate(lengths, F.array().cast("array<int>"), lambda out, n: F.concat(out, F.array(n + F.coalesce(F.try_element_at(out, F.lit(-1)) + len(t), F.lit(0)))))
    return docs.filter(text.contains(t)).select(id_col, F.explode(starts).alias("start"))
