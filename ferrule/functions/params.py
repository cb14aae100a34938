"""Parameters that come as one text, "key value key value", without separators.

A dictionary of keys cuts the text: longer keys first, so that no key is taken for the begin of another's value.
All is built-in expressions; a text becomes a map from key to the array of its values.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# The keys, as they stand in the texts.
PARAM_KEYS = [
    "Вид услуги", "Тип услуги автосервиса", "Тип услуги", "Предмет или специальность", "Специальность или сфера", "Специальность",
    "Чем вы занимаетесь", "Направление", "Название услуги", "Услуга", "Стоимость", "Тип стоимости", "Начальная цена",
    "Продолжительность", "Марка авто", "Модель", "Производители", "Техника", "Грузоподъёмность", "Длина груза", "Ширина груза",
    "Высота груза", "Место оказания услуг", "Как вы работаете", "Куда выезжаете", "Где вы оказываете услуги", "Выезд",
    "Кто оказывает услуги", "Онлайн-запись", "Опыт работы", "Работаете с юрлицами и ИП", "Работа по договору", "Гарантия на работу",
    "Гарантия", "Бригада", "Выполняю заказы от", "Минимальная сумма заказа", "Минимальное время заказа", "Предоплата",
    "Берёте ли срочные заказы", "Учебное учреждение", "Год окончания", "Преподаватель", "Занятия", "Для кого", "Ваши клиенты",
    "Рабочие дни", "Дни", "График работы, дни недели", "График работы от", "График работы до", "Время работы, с", "Время работы, до",
    "Время для связи, дни недели", "Время для связи от", "Время для связи до", "Время для связи, с", "Время для связи, до",
    "Признак предзаполнения прайс листа",
]
#: A value of the price list that says nothing.
STUB = "Своя услуга"


def pattern(keys: list[str]) -> str:
    return "(?:^| )(" + "|".join(re.escape(k).replace("\\ ", " ") for k in sorted(keys, key=len, reverse=True)) + ")(?= |$)"


def parse(text: Column, keys: list[str] | None = None) -> Column:
    """``array<struct<key, value>>`` in the order of the text; what stands before the first key is left out."""
    p = pattern(PARAM_KEYS if keys is None else keys)
    text = F.coalesce(text, F.lit(""))
    found = F.regexp_extract_all(text, F.lit(p), F.lit(1))
    values = F.transform(F.split(text, p, -1), lambda v: strip(v))
    return F.arrays_zip(found.alias("key"), F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0))).alias("value"))


def values(parsed: Column, key: str) -> Column:
    return F.transform(F.filter(parsed, lambda p: p["key"] == key), lambda p: p["value"])


def first(parsed: Column, key: str) -> Column:
    """The key's first value that is not empty, or an empty text."""
    return F.coalesce(F.get(F.filter(values(parsed, key), lambda v: v != ""), F.lit(0)), F.lit(""))


def joined(parsed: Column, keys: list[str], skip: tuple[str, ...] = ()) -> Column:
    """The distinct values of all the keys, key by key, that are not empty."""
    every = F.flatten(F.array(*[values(parsed, k) for k in keys]))
    return F.array_join(F.array_distinct(F.filter(every, lambda v: (v != "") & ~v.isin(list(skip)) if skip else v != "")), " | ")


def has(parsed: Column, key: str, needle: str) -> Column:
    return F.exists(values(parsed, key), lambda v: v.contains(needle))


def present(parsed: Column, key: str) -> Column:
    return F.exists(parsed, lambda p: p["key"] == key)


def experience_years(texts: Column) -> Column:
    """Years from the first value with a number: "less than a year" is half of one, a range its mean."""

    def one(v: Column) -> Column:
        v = F.lower(v)
        numbers = F.regexp_extract_all(v, F.lit(r"\d+"), F.lit(0))
        a, b = (F.get(numbers, F.lit(i)).cast("double") for i in (0, 1))
        return (
            F.when(v.contains("меньше года"), F.lit(0.5))
            .when(F.size(numbers) == 0, F.lit(None).cast("double"))
            .when(v.contains("больше"), a)
            .when((F.size(numbers) >= 2) & v.rlike(r"\d+\s*[–-]\s*\d+"), (a + b) / 2)
            .otherwise(a)
        )

    return F.get(F.filter(F.transform(texts, one), lambda x: x.isNotNull()), F.lit(0))


def item_fields(text: Column) -> dict[str, Column]:
    """The 21 fields of a listing's parameters."""
    p = parse(text)
    where, how, travel = "Где вы оказываете услуги", "Как вы работаете", "Куда выезжаете"
    return {
        "vid": first(p, "Вид услуги"),
        "tip": first(p, "Тип услуги"),
        "tip_auto": first(p, "Тип услуги автосервиса"),
        "subject": joined(p, ["Предмет или специальность", "Специальность или сфера", "Специальность", "Чем вы занимаетесь", "Направление"]),
        "price_list": joined(p, ["Название услуги", "Услуга"], (STUB,)),
        "brands": joined(p, ["Марка авто", "Модель", "Производители", "Техника"]),
        "address": first(p, "Место оказания услуг"),
        "work_remote": has(p, how, "Удалённ"),
        "work_online": has(p, how, "Онлайн"),
        "work_at_client": has(p, how, "У клиента") | has(p, where, "У заказчика"),
        "work_at_self": has(p, how, "У себя") | has(p, where, "У себя") | has(p, where, "В салоне"),
        "travel_city": has(p, travel, "По всему городу"),
        "travel_region": has(p, travel, "В области"),
        "travel_zones": has(p, travel, "В выбранные зоны"),
        "travel_none": has(p, travel, "Не выезжаю"),
        "online_booking": present(p, "Онлайн-запись"),
        "has_contract": present(p, "Работа по договору"),
        "has_guarantee": present(p, "Гарантия") | present(p, "Гарантия на работу"),
        "works_with_legal": present(p, "Работаете с юрлицами и ИП"),
        "experience_years": experience_years(values(p, "Опыт работы")),
        "price_list_size": (F.size(F.filter(values(p, "Название услуги"), lambda v: v != "")) + F.size(F.filter(values(p, "Услуга"), lambda v: (v != "") & (v != STUB)))).cast("long"),
    }


def search_filters(text: Column) -> dict[str, Column]:
    """The 7 filters of a search's parameters."""
    p = parse(text)
    return {
        "f_vid": first(p, "Вид услуги"),
        "f_tip": first(p, "Тип услуги"),
        "f_tip_auto": first(p, "Тип услуги автосервиса"),
        "f_subject": first(p, "Предмет или специальность"),
        "f_who": joined(p, ["Кто оказывает услуги"]),
        "f_online_booking": present(p, "Онлайн-запись"),
        "f_keys": F.array_join(F.array_sort(F.array_distinct(F.transform(p, lambda x: x["key"]))), " | "),
    }
