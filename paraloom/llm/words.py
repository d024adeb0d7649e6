"""Function words by language, and the cutting of texts into words.

Fixed values: the most frequent grammatical words of each language.
"""

from __future__ import annotations

import re

FUNCTION_WORDS = {
    "en": "the of and to in a is that for was with as on by at from were are be this had have has not or an which will "
          "but their they its been who more when than after before until unless some only where without while since "
          "would could there between into about during so up down out all these those our we it if because once through each",
    "fr": "le la les de des du et en un une à au aux dans par pour que qui est sur pas ne se son sa ses ce cette ces avec "
          "plus ont été sont mais ou où il elle nous vous leur leurs depuis avant après selon sans sous entre jusque avaient "
          "étaient était avait n d l qu s c j y dont comme si encore près",
    "es": "el la los las de del y en un una a al por para que es con no se su sus lo como más pero ha han fue sobre este esta "
          "entre desde hasta sin según cuando donde ya o e después antes solo también le les hemos había cerca todavía",
    "pt": "o a os as de do da dos das e em um uma no na nos nas por para que é com não se seu sua seus suas mais mas foi "
          "sobre até sem segundo quando onde já ou depois antes só também ao à aos às pelo pela com isso ainda desde perto cerca",
    "id": "yang dan di ke dari untuk dengan pada tidak ini itu dalam adalah oleh akan telah sudah atau juga lebih karena "
          "sebagai dapat hanya masih setelah sebelum hingga sampai tetapi namun saat tahun para kami mereka belum ada "
          "sekitar selama menurut bahwa agar tanpa",
    "ar": "في من على إلى عن مع أن التي الذي هذا هذه بعد قبل حتى ما لا لم كان كانت قد تم و ثم بين خلال عام أجل منذ بسبب",
    "th": "ใน และ ที่ ของ ได้ ให้ เป็น จาก มี ว่า ไป แต่ หรือ กับ โดย ถึง ไม่ หลัง ปี ก่อน",
}
ALL_FUNCTION_WORDS = frozenset(w for ws in FUNCTION_WORDS.values() for w in ws.split())
WORD = re.compile(r"[^\W_]+")
LETTERS = re.compile(r"[^\W\d_]+")
