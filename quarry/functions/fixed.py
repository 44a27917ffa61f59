"""They must be what they are for results to match, so they stand here together as plain text."""

ENTITY_TYPES = ("Organizacao", "Pessoa", "Lugar", "Produto", "Setor", "Evento", "Outro")
RELATION_TYPES = ("CONTROLA", "ADQUIRIU", "FORNECE_PARA", "CONCORRE_COM", "ATUA_EM", "PRODUZ", "LOCALIZADA_EM", "TRABALHA_EM", "PARTICIPOU_DE", "RELACIONADA_A")
DEFAULT_ENTITY, DEFAULT_RELATION = "Outro", "RELACIONADA_A"
OUTGOING, INCOMING = "saindo", "entrando"

#: Company suffixes that a name's key leaves out, and words that an acronym leaves out.
COMPANY_SUFFIX = r"\b(s\s*a|sa|ltda|s\s*/\s*a|inc|corp|corporation|company|cia)\b"
ACRONYM_STOP = ("de", "da", "do", "das", "dos", "e", "em", "para", "a", "o")
#: Words that don't tell companies apart in running text.
SHORT_NAME_NOISE = r"(?<!\w)(s\.?a\.?|sa|ltda|holding|participacoes|participações|global|foods|brasil|do brasil|banco|cia|companhia|energia|s/a)(?!\w)"
FILING_CATEGORIES = ("Fato Relevante", "Comunicado ao Mercado")
FILING_OPERATION = r"aquisi|incorpora|fus[ãa]o|combina|participa|acordo|venda|compra|joint|cis[ãa]o|desinvestimento|oferta"
FILING_COLUMNS = ("Nome_Companhia", "Assunto", "Categoria", "Data_Entrega", "Protocolo_Entrega", "Link_Download")

#: Words by which a question is routed: to a relation between entities, to a bridge that it describes, to a synthesis.
ROUTE_RELATION = r"\b(liga[cç][aã]o|rela[cç][aã]o|conex[aã]o|entre|v[ií]nculo|depend[eê]|fornece|controla|adquiriu|mesma|mesmo)\b"
ROUTE_BRIDGE = (
    r"\b(envolvid[ao]s?|envolvendo|participante|resultante|decorrente|referid[ao]s?)\b"
    r"|\b(opera[cç][aã]o|transa[cç][aã]o|aquisi[cç][aã]o|incorpora[cç][aã]o|fus[aã]o|neg[oó]cio|contrato)\s+(d[ao]s?|envolvendo|entre|com)\b"
    r"|\bque\s+(a|o|foi|foram|fez|fizeram|comprou|vendeu|adquiriu)\b"
)
ROUTE_SYNTHESIS = r"\b(quais|liste|lista|resuma|resumo|panorama|todos|todas|principais)\b"
#: kind: (limit, candidate pool, graph weight, rerank)
STRATEGIES = {"factual": (4, 20, 0.2, True), "relacional": (6, 30, 1.0, True), "sintese": (10, 40, 0.6, False)}

HEADING = r"^(={2,6})\s*(.+?)\s*\1$"
SENTENCE_BREAK = r"(?<=[.!?])\s+(?=[A-ZÁÀÂÃÉÊÍÓÔÕÚÇ])"
CITATION = r"\[(\d+)\]"
NO_CHUNKS = "Nao encontrei nada no corpus indexado sobre essa pergunta."
NO_CHUNKS_WARNING = "nenhum trecho recuperado"
NO_ANSWER = "Nao consegui gerar a resposta."
UNCITED_WARNING = "a resposta nao citou nenhuma fonte -- trate-a como nao verificada"
INVENTED_WARNING = "o modelo citou fonte(s) inexistente(s): {}; removidas da resposta"

TEXT_SUFFIXES = (".md", ".markdown", ".txt", ".rst")
PDF_SUFFIXES, DOCX_SUFFIXES, SHEET_SUFFIXES, CSV_SUFFIXES = (".pdf",), (".docx",), (".xlsx", ".xlsm"), (".csv", ".tsv")
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".webp", ".bmp", ".tiff", ".tif")
MAX_BYTES = 50 * 1024 * 1024
MIN_CHARS_PER_PAGE = 40
ALLOWED_HOSTS = ("pt.wikipedia.org", "en.wikipedia.org")

RRF_K, POOL, SEED_LIMIT, FANOUT, HUB_RATIO, HUB_FLOOR = 60, 20, 12, 40, 0.05, 3
EVIDENCE_CHARS, CONTEXT_CHARS, TITLE_CHARS = 500, 1200, 180

#: Portuguese words without weight in search.
STOP_WORDS = (
    "a ao aos as com como da das de dela delas dele deles depois do dos e ela elas ele eles em entre era essa essas esse esses esta "
    "estas este estes eu foi foram ha isso isto ja la mais mas me mesmo meu minha muito na nao nas nem no nos nossa nosso num numa o os "
    "ou para pela pelas pelo pelos por qual quais quando que quem se sem ser seu seus so sua suas tambem te tem um uma voce"
).split()

#: Titles of the demonstration corpus.
DEMO_CORPUS = (
    "Petrobras", "Vale S.A.", "Companhia Siderúrgica Nacional", "Usiminas", "Gerdau", "Braskem", "Axia Energia",
    "Companhia Energética de Minas Gerais", "Companhia Paranaense de Energia", "Engie Brasil", "Suzano Papel e Celulose", "Klabin", "JBS",
    "BRF", "Cosan", "Raízen", "Banco do Brasil", "Itaú Unibanco", "Bradesco", "Banco Nacional de Desenvolvimento Econômico e Social",
    "B3 (bolsa de valores)", "Banco Central do Brasil", "Embraer", "WEG S.A.", "Ambev", "Localiza", "Grupo Ultra", "Natura",
)
