"""Schemas of the document audit: recognised pages, inventory, registry, findings."""

from __future__ import annotations

WORD = "struct<text:string,x:double,y:double,width:double,height:double>"
OCR = f"file string, text string, language string, width int, height int, lines array<struct<text:string,words:array<{WORD}>>>"
BOUNDS = "struct<x:float,y:float,w:float,h:float>"
READING = "struct<field:string,value:string,status:string,candidates:array<string>,sources:array<string>,agreement:int,attempts:int>"
SIGNATURE = "struct<role:string,name:string,organization:string,status:string,approval:boolean>"
PAGE = (
    "photo_id int, kind string, code string, tom string, organization string, book string, chief string, crc string, revision int, page int, book_number int, text string, "
    f"sections map<string,string>, signatures array<{SIGNATURE}>, seal struct<status:string,score:double>, readings array<{READING}>, fragments map<int,string>"
)
INVENTORY = "seq int, code string, tom string, book string, documentation_kind string, revision int, box int, book_number int, photo_id int, sections map<string,string>, anchor_y double, book_continuation boolean"
REGISTRY = "row int, file string, " + ", ".join(f"c{i} string" for i in range(1, 21)) + ", first_date string"
FINDING = "level string, code string, topic string, detail string, photos array<int>"
COLUMNS_USED = {"file": "c3", "extension": "c4", "date": "c6", "time": "c7", "checksum": "c8", "reviewer": "c9", "checked": "c10", "kind": "c11", "box": "c12"}

# Kinds of pages.
INVENTORY_KIND, IUL, TITLE, FRAGMENT_TITLE, UNKNOWN_KIND = "Опись", "ИУЛ", "Титул", "Титул фрагмента", "Не определено"
