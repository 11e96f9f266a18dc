"""Word lists, kinds and constants that results depend on.

They are stated as they are, because other values would give other results.
Everything here is a default; the functions that use them take them as parameters.
"""

# Words that carry no meaning in a knowledge-base question.
KB_STOP_WORDS = """
как что где когда почему зачем какой какая какие каким каком который которая
в во на и или по для не ни с со а ли это этот эта эти из к ко у о об от до за при
же бы то там тут можно нужно надо есть был была были быть будет мне меня мы вы
он она они его ее их все всех так также если чтобы через после перед под над
the a an of to in on for and or is are how what why
""".split()

# Words that carry no meaning in a code question.
CODE_STOP_WORDS = """
где как что чем кто когда почему зачем куда откуда какая какой какие какое каком какую каким
это этот эта эти или для при над под без про через если чтобы есть был была были быть будет
такое такой так тоже также все всех его нее них она они оно мне нам вам
делает делают делается происходит находится нужно можно надо называется
процедура процедуры процедуре процедуру процедурой функция функции функцию функцией
метод метода методе методы модуль модуля модуле модули код кода коде
the and for what where how does this that with from
""".split()

# Russian endings that stemming cuts.
RU_ENDINGS = """
иями ями ами иях ием ией иям ии ого его ому ему ыми ими ая яя ое ее ые ие ый ий ой ую юю ых их ым им ом ем
ов ев ей ия ию ью ья ье ам ям ах ях
ается яется аются яются ится ются утся атся ятся ться тся
ение ения ению ением ении ений ание ания анию анием ании аний
ает яет ают яют ует уют ить ать ять еть ыть уть ет ит ют ут ят ат ал ил ел ыл ала ила ели али или ыли ть ти
а я о е ы и у ю ь й
""".split()

# English endings for texts without Cyrillic letters.
EN_ENDINGS = "ations ation ings ing edly ed ers er es ly s".split()

# How things are asked for and how they are named.
SYNONYMS = {
    "счит": ["расчет", "рассчит", "расчит"],
    "расчет": ["рассчит", "расчит"],
    "рассчит": ["расчет"],
    "провод": ["проведен", "провест"],
    "проведен": ["провест", "провод"],
    "печат": ["печатн"],
    "созда": ["создан", "новый"],
    "удал": ["удален"],
    "запис": ["записат"],
    "откры": ["открыт"],
    "остатк": ["остаток"],
}

# Stems of questions about the structure of an object.
STRUCTURE_STEMS = """
реквизит состав структур табличн измерен ресурс синоним регламентн подписк движен колонк поля пол
""".split()

# Product rules (name, keywords counted in title and text start) and the product without a match.
PRODUCT_RULES = [
    ("ОСИ/ЖКХ", ["кондоминиум", "жкх", "жильц", "оси", "квитанц", "лицев", "расчетн центр",
                 "расчётн центр", "собственник", "пени", "начислени"]),
    ("Обменный пункт", ["обменн", "кассир", "вебкасс", "курс валют", "фрому", "терроризм",
                        "aml", "национальн банк", "отчетов нб", "золот", "табло", "валют"]),
]
DEFAULT_PRODUCT = "Общее"

# Folder of an export, kind in type names, shown kind.
OBJECT_KINDS = [line.split() for line in """
CommonModules CommonModule ОбщийМодуль
Catalogs Catalog Справочник
Documents Document Документ
DocumentJournals DocumentJournal ЖурналДокументов
Enums Enum Перечисление
Reports Report Отчет
DataProcessors DataProcessor Обработка
InformationRegisters InformationRegister РегистрСведений
AccumulationRegisters AccumulationRegister РегистрНакопления
AccountingRegisters AccountingRegister РегистрБухгалтерии
CalculationRegisters CalculationRegister РегистрРасчета
ChartsOfCharacteristicTypes ChartOfCharacteristicTypes ПланВидовХарактеристик
ChartsOfAccounts ChartOfAccounts ПланСчетов
ChartsOfCalculationTypes ChartOfCalculationTypes ПланВидовРасчета
BusinessProcesses BusinessProcess БизнесПроцесс
Tasks Task Задача
ExchangePlans ExchangePlan ПланОбмена
Constants Constant Константа
CommonForms CommonForm ОбщаяФорма
CommonCommands CommonCommand ОбщаяКоманда
WebServices WebService WebСервис
HTTPServices HTTPService HTTPСервис
SettingsStorages SettingsStorage ХранилищеНастроек
FilterCriteria FilterCriterion КритерийОтбора
Sequences Sequence Последовательность
ScheduledJobs ScheduledJob РегламентноеЗадание
EventSubscriptions EventSubscription ПодпискаНаСобытие
Subsystems Subsystem Подсистема
DefinedTypes DefinedType ОпределяемыйТип
FunctionalOptions FunctionalOption ФункциональнаяОпция
CommonAttributes CommonAttribute ОбщийРеквизит
SessionParameters SessionParameter ПараметрСеанса
ExternalDataSources ExternalDataSource ВнешнийИсточникДанных
Roles Role Роль
CommonTemplates CommonTemplate ОбщийМакет
""".strip().split("\n")]
FOLDERS_WITHOUT_STRUCTURE = ["Roles", "CommonTemplates", "CommonModules", "CommonForms"]

# Module file name, shown module kind.
MODULE_KINDS = dict(line.split() for line in """
objectmodule МодульОбъекта
managermodule МодульМенеджера
recordsetmodule МодульНабораЗаписей
valuemanagermodule МодульМенеджераЗначения
commandmodule МодульКоманды
managedapplicationmodule МодульУправляемогоПриложения
ordinaryapplicationmodule МодульОбычногоПриложения
sessionmodule МодульСеанса
externalconnectionmodule МодульВнешнегоСоединения
""".strip().split("\n"))

# Primitive types and their shown names.
PRIMITIVE_TYPES = {
    "string": "Строка", "decimal": "Число", "number": "Число", "boolean": "Булево", "datetime": "Дата",
    "date": "Дата", "valuestorage": "ХранилищеЗначения", "uuid": "УникальныйИдентификатор",
}

# Transliteration of Cyrillic letters in slugs.
TRANSLIT = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", [
    "a", "b", "v", "g", "d", "e", "e", "zh", "z", "i", "y", "k", "l", "m", "n", "o", "p", "r", "s", "t", "u",
    "f", "h", "ts", "ch", "sh", "sch", "", "y", "", "e", "yu", "ya"]))

# Path parts of a published address that come after its name.
SERVICE_PARTS = ["hs", "odata", "ws", "ru_ru", "en_us", "ru", "en", "e1cib", "e1csys"]

# Plural type names that people write.
PLURAL_TYPES = {
    "документы": "Документ", "справочники": "Справочник", "отчеты": "Отчет", "обработки": "Обработка", "перечисления": "Перечисление",
    "регистрысведений": "РегистрСведений", "регистрынакопления": "РегистрНакопления", "общиемодули": "ОбщийМодуль", "константы": "Константа",
}

# Word, link and token patterns.
WORD = r"[0-9A-Za-zА-Яа-яЁё]+"
CODE_WORD = r"[0-9A-Za-zА-Яа-яЁё_]+"
CAMEL = r"[А-ЯЁA-Z]+(?![а-яёa-z])|[А-ЯЁA-Z]?[а-яёa-z]+|\d+"
LINK = r"(?i)https?://[^\s<>\"'«»]+"
TOKEN = r"\[[A-Za-zА-Яа-яЁё]{2,8}-[0-9A-F]{6,64}\]"

# Texts of the cleaned answer.
HIDDEN_PATH = "[путь скрыт]"
WINDOWS_PATH = r"(?:[A-Za-z]:\\|\\\\)[^\s\"'<>|]*"
UNIX_PATH = r"(?U)(?<![\w/])/(?:home|tmp|var|usr|etc|Users|opt|root|mnt)/[^\s\"'<>|]*"
SYSTEM_TAG = r"(?i)</?(system-reminder|thinking|antml:[\w-]+)[^>]*>"
TOOL_NAME = r"(?U)`?mcp__\w+`?"
CODE_FENCE = r"(?m)^```[\w-]*\s*$"
HEADING = r"(?m)^\s{0,3}#{1,6}\s+"
BOLD = r"(?s)\*\*(.+?)\*\*|__(.+?)__"

# What a limit message looks like and how it tells the time.
LIMIT_HIT = r"(?i)(usage limit|limit reached|limit will reset|out of (extra )?usage|лимит)"
LIMIT_STAMP = r"\|(\d{10})\b"
LIMIT_CLOCK = r"(?i)resets?\s+(?:at\s+)?(\d{1,2})(?::(\d{2}))?\s*(am|pm)?"

# Token categories.
CATEGORIES = {
    "ФЛ": "Имена людей", "ОРГ": "Организации и контрагенты", "ИИН": "ИИН, БИН, РНН", "ТЕЛ": "Телефоны",
    "EMAIL": "Электронная почта", "АДР": "Адреса", "СЧЕТ": "Банковские счета", "КАРТА": "Номера карт",
    "ДОК": "Номера документов", "ДОГ": "Договоры", "УДЛ": "Паспорта и удостоверения", "КОД": "Прочие коды и номера",
}
