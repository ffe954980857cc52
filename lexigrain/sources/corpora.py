"""Small corpora in memory, and generators of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Ten short news texts.
NEWS = (
    "курс доллара вырос",
    "доллар подорожал сегодня",
    "курс американской валюты вырос",
    "акции компании резко упали",
    "цена акций компании снизилась",
    "команда выиграла матч",
    "футболист забил два гола",
    "команда победила в матче",
    "новый смартфон поступил в продажу",
    "компания представила новый смартфон",
)
# Twenty-four support tickets: login, payment, delivery, return, other.
TICKETS = (
    "Клиент не может войти в личный кабинет после смены пароля",
    "Не получается авторизоваться в личном кабинете, пароль не принимается",
    "Пользователь забыл пароль и не может войти в аккаунт",
    "После изменения пароля клиент не может выполнить вход",
    "Ошибка авторизации при входе в личный кабинет",
    "Не проходит оплата банковской картой",
    "Клиент не может оплатить заказ картой",
    "Ошибка при оплате банковской картой",
    "Платеж картой отклонен при оформлении заказа",
    "Не удается провести оплату по карте",
    "Клиент не получил заказ в указанный срок",
    "Заказ задерживается, доставка еще не выполнена",
    "Посылка не пришла в ожидаемую дату",
    "Задержка доставки заказа клиенту",
    "Когда будет доставлен мой заказ",
    "Как вернуть товар и получить деньги обратно",
    "Клиент хочет оформить возврат товара",
    "Необходимо вернуть заказ и оформить возврат средств",
    "Как оформить возврат покупки",
    "Возврат товара после получения заказа",
    "Хочу изменить адрес доставки для заказа",
    "Как поменять номер телефона в профиле",
    "Приложение закрывается при запуске",
    "Не приходит код подтверждения на телефон",
)
# Five ticket templates of three columns.
TEMPLATES = (
    ("Не проходит оплата картой на сайте. Деньги списались, но статус заказа не изменился.", "Проверен транзакционный лог эквайринга.", "Оформлен возврат денежных средств клиенту."),
    ("Не могу войти в личный кабинет. Не приходит смс с кодом подтверждения.", "Проверена отправка шлюза сообщений.", "Сброшен профиль авторизации, отправлена ссылка на email."),
    ("Задерживается доставка заказа курьером. Прошло уже более трех дней.", "Связались с логистической службой.", "Переназначили время доставки курьером на завтра."),
    ("Пришел поврежденный товар в разбитой упаковке. Хочу вернуть деньги.", "Запрошены фотографии повреждений у покупателя.", "Составлен акт брака, направлен курьер для забора."),
    ("Прошу удалить мои персональные данные и заблокировать аккаунт.", "Проведена идентификация пользователя.", "Профиль заблокирован, данные удалены из базы."),
)
#: Topics of the labelled generator and words they are told apart by.
TOPICS = {
    "оплата": "карта платёж списание банк комиссия чек перевод",
    "доставка": "курьер посылка адрес задержка склад трек маршрут",
    "возврат": "возврат обмен деньги заявление упаковка брак экспертиза",
    "вход": "пароль логин кабинет код авторизация смс профиль",
    "связь": "интернет роутер скорость сигнал линия тариф обрыв",
    "страховка": "полис страховая выплата случай договор оценка ущерб",
    "ремонт": "мастер деталь гарантия поломка сервис диагностика запчасть",
    "мебель": "шкаф сборка полка фурнитура стол дверца ящик",
    "поездка": "билет рейс гостиница бронь багаж виза экскурсия",
    "еда": "ресторан блюдо заказчик кухня завтрак меню десерт",
    "спорт": "матч команда тренер гол турнир стадион победа",
    "наука": "опыт статья лаборатория гипотеза данные прибор вывод",
}
COMMON = "добрый день прошу помочь срочно вопрос ответ пишу повторно спасибо заранее"
SUFFIXES = ("ами", "ов", "ом", "ский", "ная")


def _in_memory(spark: SparkSession, texts: tuple[str, ...]) -> DataFrame:
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")


def news(spark: SparkSession) -> DataFrame:
    return _in_memory(spark, NEWS)


def tickets(spark: SparkSession) -> DataFrame:
    return _in_memory(spark, TICKETS)


def template_tickets(spark: SparkSession, n: int = 100_000) -> DataFrame:
    """``row_id, col1, col2, col3``: the templates in turn, each ``col1`` with its own number."""
    t = F.array(*[F.struct(*[F.lit(x).alias(f"c{i}") for i, x in enumerate(row, 1)]) for row in TEMPLATES])
    row = F.get(t, (F.col("id") % len(TEMPLATES)).cast("int"))
    rows = spark.range(n).select(F.col("id").alias("row_id"), row.alias("r"))
    return rows.select("row_id", F.concat("r.c1", F.lit(" [ID обращение "), F.col("row_id").cast("string"), F.lit("]")).alias("col1"), F.col("r.c2").alias("col2"), F.col("r.c3").alias("col3"))


def labelled_topics(spark: SparkSession, per_class: int = 500, seed: int = 42) -> DataFrame:
    """``doc_id, text, label``: 5 to 12 words of a topic (nearly half of the texts with one inflected), 1 to 4 everyday words, mixed order.

    Every choice is a hash of seed, document and place, so the corpus is the
    same under any partitioning.
    """
    hexes = lambda *salt: F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"), *[x.cast("string") for x in salt])), 1, 12)
    pick = lambda *salt: F.conv(hexes(*salt), 16, 10).cast("bigint")  # noqa: E731  (MD5, which SQL engines share)
    words = F.array(*[F.array(*map(F.lit, w.split())) for w in TOPICS.values()])
    names = F.array(*map(F.lit, TOPICS))
    everyday = F.array(*map(F.lit, COMMON.split()))
    topic = (F.col("id") % len(TOPICS)).cast("int")
    choose = lambda a, x: F.get(a, (x % F.size(a)).cast("int"))
    own = F.get(words, topic)
    n = (pick(F.lit("n")) % 8 + 5).cast("int")
    chosen = F.transform(F.sequence(F.lit(1), n), lambda i: choose(own, pick(F.lit("w"), i)))
    inflected = F.when(pick(F.lit("s")) % 100 < 45, F.concat(F.get(chosen, F.lit(0)), choose(F.array(*map(F.lit, SUFFIXES)), pick(F.lit("e"))))).otherwise(F.get(chosen, F.lit(0)))
    common = F.transform(F.sequence(F.lit(1), (pick(F.lit("m")) % 4 + 1).cast("int")), lambda i: choose(everyday, pick(F.lit("c"), i)))
    every = F.concat(F.array(inflected), F.slice(chosen, 2, 20), common)
    mixed = F.transform(F.array_sort(F.transform(every, lambda x, i: F.struct(pick(F.lit("o"), i).alias("k"), x.alias("x")))), lambda s: s["x"])
    end = F.get(F.array(*map(F.lit, ("", ".", "!", "?", "..."))), (pick(F.lit("p")) % 5).cast("int"))
    return spark.range(per_class * len(TOPICS)).select(F.col("id").alias("doc_id"), F.concat(F.array_join(mixed, " "), end).alias("text"), F.get(names, topic).alias("label"))
