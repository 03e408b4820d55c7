"""Fixed values of the source format: names, maps and kinds that results must agree on."""

# Collection names in code and the object folders they stand for.
COLLECTIONS = {
    "Документы": "Documents", "Справочники": "Catalogs", "РегистрыСведений": "InformationRegisters", "РегистрыНакопления": "AccumulationRegisters",
    "РегистрыБухгалтерии": "AccountingRegisters", "ПланыСчетов": "ChartsOfAccounts", "Перечисления": "Enums", "ОбщиеМодули": "CommonModules",
    "Обработки": "DataProcessors", "Отчеты": "Reports", "Роли": "Roles",
}

# First part of a reference in a rights file and the object folder.
RIGHTS_PREFIXES = {
    "Catalog": "Catalogs", "CatalogObject": "Catalogs", "Document": "Documents", "DocumentObject": "Documents", "InformationRegister": "InformationRegisters",
    "AccumulationRegister": "AccumulationRegisters", "AccountingRegister": "AccountingRegisters", "DataProcessor": "DataProcessors", "Report": "Reports",
    "CommonModule": "CommonModules", "Enum": "Enums", "ChartOfAccounts": "ChartsOfAccounts", "ChartOfCharacteristicTypes": "ChartsOfCharacteristicTypes",
    "BusinessProcess": "BusinessProcesses", "Task": "Tasks", "ExchangePlan": "ExchangePlans", "Constant": "Constants", "FilterCriterion": "FilterCriteria",
    "HTTPService": "HTTPServices", "WebService": "WebServices", "CommonForm": "CommonForms", "CommonCommand": "CommonCommands", "Subsystem": "Subsystems",
}

# Type names of the user interface.
TYPE_FILTER = {
    "Справочник": "Catalogs", "Документ": "Documents", "РегистрСведений": "InformationRegisters", "РегистрНакопления": "AccumulationRegisters",
    "РегистрБухгалтерии": "AccountingRegisters", "Обработка": "DataProcessors", "Отчет": "Reports", "ОбщийМодуль": "CommonModules",
    "Перечисление": "Enums", "ПланСчетов": "ChartsOfAccounts", "Роль": "Roles", "ШаблонПрав": "RoleTemplates", "МакетСКД": "Templates",
}

OBJECT_DIRS = ["Catalogs", "Documents", "InformationRegisters", "AccumulationRegisters", "AccountingRegisters", "DataProcessors", "Reports", "CommonModules", "Enums", "ChartsOfAccounts"]
FALLBACK_TYPES = ["Catalogs", "Documents", "InformationRegisters", "AccumulationRegisters", "CommonModules", "Enums", "DataProcessors", "Reports", "Roles"]

TEMPLATE_KINDS = {
    "DataCompositionSchema": "Макет СКД (схема компоновки данных)", "SpreadsheetDocument": "Табличный документ (MXL, печатная форма)", "HTMLDocument": "HTML-документ",
    "TextDocument": "Текстовый документ", "BinaryData": "Двоичные данные", "ActiveDocument": "ActiveDocument", "GeographicalSchema": "Географическая схема",
    "GraphicalSchema": "Графическая схема", "Template": "Макет",
}

INTENT_MARKERS = ["завис", "ссыл", "влия", "использу", "связ", "затрон", "impact", "depend", "where used"]
NODE_TYPES = ["Metadata", "Method", "Form"]
EDGE_TYPES = ["REFERENCES", "HAS_METHOD", "HAS_FORM", "ATTRIBUTE_TYPE", "USES_IN_CODE", "HAS_RIGHT", "HAS_TEMPLATE"]
DIRECTIVES = ["НаКлиентеНаСервереБезКонтекста", "НаСервереБезКонтекста", "НаКлиенте", "НаСервере", "AtClientAtServerNoContext", "AtServerNoContext", "AtClient", "AtServer"]
# Vector size and input tokens of known models, in the order they are tried; sizes of one family by its scale.
MODEL_DIMS = {
    "nomic-ai/nomic-embed-text-v1.5": (768, 8192), "nomic-ai/nomic-embed-text-v1": (768, 8192), "nomic-embed-text-v1.5": (768, 8192), "nomic-embed-text-v1": (768, 8192), "nomic-embed-text-v2-moe": (768, 512),
    "sentence-transformers/paraphrase-multilingual-minilm-l12-v2": (384, 512), "paraphrase-multilingual-minilm-l12-v2": (384, 512), "sentence-transformers/all-minilm-l6-v2": (384, 256), "all-minilm-l6-v2": (384, 256),
    "baai/bge-m3": (1024, 8192), "bge-m3": (1024, 8192), "baai/bge-small-en-v1.5": (384, 512), "baai/bge-base-en-v1.5": (768, 512), "baai/bge-large-en-v1.5": (1024, 512),
    "intfloat/multilingual-e5-large": (1024, 512), "intfloat/multilingual-e5-base": (768, 512), "intfloat/multilingual-e5-small": (384, 512), "intfloat/e5-mistral-7b-instruct": (4096, 32768),
    "jinaai/jina-embeddings-v3": (1024, 8192), "jinaai/jina-embeddings-v2-base-en": (768, 8192), "cohere/embed-multilingual-v3.0": (1024, 512), "cohere/embed-english-v3.0": (1024, 512),
    "text-embedding-ada-002": (1536, 8191), "text-embedding-3-small": (1536, 8191), "text-embedding-3-large": (3072, 8191), "ibm-granite/granite-embedding-125m-english": (768, 512), "ibm-granite/granite-embedding-30m-english": (384, 512),
}
QWEN3_DIMS = {"0.6b": 1024, "1.7b": 2048, "4b": 2560, "8b": 4096}
