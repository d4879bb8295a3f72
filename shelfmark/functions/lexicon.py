"""Word lists and patterns of the offer texts.

Fixed values: every entry below must stay as it is, because the flag tokens
become TF-IDF terms and the lists decide which fields are blanked.
"""

# Vendor names that stand for "no brand" (compared stripped and lower-cased).
NO_BRAND = (
    "нет бренда", "без бренда", "no brand", "нет брендаs", "без брендаs", "",
    "没有品牌", "无品牌", "другие бренды", "другие", "другойбренд",
    "универсальный", "универсальная", "н/а", "н.а", "n/a", "na", "unknown",
    "jiemiwl", "romiky", "jiemi", "джи чонг", "juxiangying", "linglingmaoyi",
    "muzimaoyi", "qingyemaoyi", "nobrand", "no_brand", "oem", "generic", "прочие",
)

# Vendor-code stems of resellers.
RESELLER_STEMS = r"jiemiwl|jiemi|romiky|juxiang|linglin|muzimao|qingye"

# Strings a delimited file uses for "missing".
MISSING_STRINGS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# Units and dimensions, searched in the lower-cased raw title.
UNIT_FLAGS = (
    ("__feat_memory__", r"\d+\s*(гб|gb|мб|mb)"),
    ("__feat_watt__", r"\d+\s*(вт|w\b|ватт)"),
    ("__feat_inch__", r"\d+\s*(дюйм|inch|\")"),
    ("__feat_volume__", r"\d+\s*(л\b|мл|литр)"),
    ("__feat_size__", r"\d+\s*(см|мм|mm|cm)\b"),
    ("__feat_weight__", r"\d+\s*(кг|г\b|грамм)"),
    ("__feat_volt__", r"\d+\s*(v\b|вольт)"),
    ("__feat_dims__", r"\d+x\d+"),
)

# Product-type stems, searched in the lower-cased raw title.
TYPE_FLAGS = (
    ("__type_clothing__", r"\b(футболк|джинс|платье|куртк|пальто|свитер|худи|леггинс|шорты|юбк|носки|трусы|бюстгальтер|купальник|колготки|кардиган|блузк|рубашк|толстовк)"),
    ("__type_shoes__", r"\b(кроссовк|туфли|ботинки|сапоги|кеды|сандали|тапочк|мокасин|слипон)"),
    ("__type_food__", r"\b(консерв|крупа|мука|сахар|чай|кофе|шоколад|конфет|печенье|масло|соус|лапш|рис\b|специ|пряност|приправ)"),
    ("__type_cosmetic__", r"\b(крем|шампунь|гель|помад|тушь|тональн|духи|парфюм|дезодорант|лосьон|сыворотк|маска для лица|мицеллярн)"),
    ("__type_phone__", r"\b(чехол|наушники|зарядк|powerbank|power bank|кабель usb|беспроводн зарядк|защитн стекл)"),
    ("__type_tool__", r"\b(дрель|перфоратор|шуруповерт|болгарка|лобзик|отвертк|гайковерт|шлифовальн|сварочн|пневматическ|бесщеточн|гравер|сверл|фреза|плоскогубц|ключ разводн|зубило|стамеска|рубанок)"),
    ("__type_plumbing__", r"\b(термостат|душевой|биде|смеситель|труб|клапан|фитинг|муфта|сифон|слив|унитаз|ванн|радиатор|котел|котёл|насос\b|помп|кран\b|водонагреватель)"),
    ("__type_electric__", r"\b(розетк|выключател|автомат\b|щиток|провод\b|кабель\b|клемм|трансформатор|инвертор|диммер|реле\b|датчик|удлинитель)"),
    ("__type_garden__", r"\b(семена|удобрение|горшок|лопат|грабли|шланг|газонокосилк|теплиц|садов|карбюратор|триммер|культиватор|поливочн|клумб|рассад|кашпо|скарификатор|аэратор|опрыскивател|мотоблок|бензопил)"),
    ("__type_pet__", r"\b(корм для|лоток|поводок|ошейник|клетка|аквариум|переноск|когтеточк)"),
    ("__type_book__", r"\b(книга|учебник|роман|повесть|сборник|энциклопедия|журнал|комикс)"),
    ("__type_pc__", r"\b(ноутбук|монитор|принтер|клавиатур|мышь\b|ssd|nvme|процессор|видеокарт|материнск|оперативн|жестк.диск|usb.хаб|картридж|проектор|сканер|xbox|playstation|nintendo|ps[0-9]|wi-fi|роутер|системный блок|веб.камер)"),
    ("__type_appliance__", r"\b(пылесос|стиральн|посудомоечн|холодильник|морозильник|кондиционер|обогреватель|вентилятор\b|фен\b|мультиварк|блендер|миксер|тостер|утюг|кофемашин|соковыжималк|хлебопечк|аэрогриль)"),
    ("__type_climate__", r"\b(нагреватель|тепловентилятор|увлажнитель|осушитель|вытяжк|котёл|котел|инфракрасн обогрев)"),
    ("__type_sport__", r"\b(гантел|коврик для йоги|велосипед|самокат|ракетк|мяч|боксерск|груша\b|велотренажер|дайвинг|shimano|байдарк|каяк|туристическ|лыж|сноуборд|альпинизм|страховочн|спальный мешок)"),
    ("__type_home__", r"\b(тумба|ваза|прихожей|прикроватн|мебель\b|стеллаж|светильник|люстра|бра\b|ночник|торшер|карниз|жалюзи|шторы|покрывало|подушк|одеял|скатерть|диван|кресл)"),
    ("__type_auto__", r"\b(автомагнол|магнитол|мотогарнитур|видеорегистратор|автосигнализ|парктроник|автомобильн)"),
)

# Description topics, searched in the lower-cased description without tags.
DESCRIPTION_FLAGS = (
    ("__desc_material__", r"материал\s*:"),
    ("__desc_composition__", r"состав\s*:"),
    ("__desc_power__", r"мощност"),
    ("__desc_size__", r"размер\s*:"),
    ("__desc_usage__", r"применени"),
    ("__desc_os__", r"windows|macos|android|процессор|оперативн"),
    ("__desc_energy__", r"электропотреблени|потребляемая мощност|энергопотреблени"),
    ("__desc_garden__", r"посадк|почв|поли[вт]|садов|огород"),
    ("__desc_install__", r"установк|монтаж|крепл|сборк"),
    ("__desc_plumbing__", r"диаметр|резьба|dn\d|pp-r|pex|фитинг"),
    ("__desc_kids__", r"возраст|для детей|детск"),
    ("__desc_material_kw__", r"нержавеющ|алюминий|пластик|металл|дерев|силикон|керамик"),
)

# Tokens for a missing, a short and a long description, and the two length limits.
NO_DESCRIPTION = "__no_desc__"
SHORT_DESCRIPTION = "__desc_short__"
LONG_DESCRIPTION = "__desc_long__"
SHORT_BELOW = 100
LONG_ABOVE = 2000
