"""Fixed values of the language and its framework: names that results have to match, one a row."""

# Variables of the framework.
RESERVED = (
    "cFilAnt",
    "cEmpAnt",
    "cUserName",
    "cModulo",
    "cTransac",
    "nProgAnt",
    "dDataBase",
    "cFunBkp",
    "cFunName",
    "oMainWnd",
    "__cInternet",
    "__Language",
    "nUsado",
    "PARAMIXB",
    "aRotina",
    "lMsErroAuto",
    "lMsHelpAuto",
    "lAutoErrNoFile",
    "INCLUI",
    "ALTERA",
)

# Restricted functions. What to use instead comes from a catalog (sources.catalogs), not from here.
RESTRICTED = (
    "StaticCall",
    "PTInternal",
    "VALIDAAUTONFE",
    "MA410IMPOS",
    "MALIBDOFAT",
    "TFONTEX",
    "NFEPROCNFE",
    "AVCPYFILE",
    "F_OPCOES",
    "AUTONFEENV",
    "MASAPREREQ",
    "FTVDVENDA",
    "MAALCDOC",
    "FISA022TRS",
    "FGX_STATF2",
    "NG400TAR",
    "CODSITRI",
    "IW_MULTILINE",
    "FWCHKFUNCACCESS",
    "WSNFESBRA",
    "SPEDDANFE",
    "SPEDPEXP",
    "WebService NFESBra",
    "CBGrvEti",
    "A460ESTORNA",
    "GETNUMSC7",
    "ISCAIXALOJA",
    "XNUMCAIXA",
    "CALCEST / CALCESTL",
    "FRTGERASL",
    "MSCLEARBUFFER",
    "CA100INCL",
    "SPEDNFERE2",
    "FCARRTAB",
    "SALDOTERC",
    "FABAIXACR",
    "A093PROD",
    "OOBJ:GETDATA",
    "AVSTACTION",
    "VTGETSENHA",
    "A450GRAVA",
    "OPENSXS",
    "FINA110",
    "A410INCLUI",
    "FP_CODFOL",
    "NFECABDOC",
    "OPENSRC",
    "EXTRACT",
    "INCNOTA",
    "MOVIMENTO",
    "ATFA050",
    "PLSQUERY",
    "PROXNUM",
    "FILE2PRINTER",
    "SPF_SEEK",
    "SPF_UPDATE",
    "FWSQLUsrFilial",
    "APPEND FROM",
    "ACPORET",
    "FBUSCACPO",
    "LASTKEY",
    "RPCSETYPE",
    "WFPREPENV",
    "SALDOB2",
    "TMSA050EDI",
    "GERATMP",
    "A103ATUSE2",
    "CTBANFS",
    "WAITRUNSRV",
    "A103CONSNFESEF",
    "SPDCRIATRB",
    "A103NFISCAL",
    "TTPVIEWER",
    "MACANDELF2",
    "MADELNFS",
    "RET_CBARRA",
    "A440LIBERA",
    "RFMASHUPS",
    "FWJWT2BEAR",
    "CTGERPLAN",
    "NXTSX5NOTA",
    "FMONTA_TPR",
    "COPY TO",
    "FDIASAFASPERIODO",
    "CBCHKTEMPLATE",
    "MsExcel",
    "ENGSX3117",
    "FWLOOKUP",
    "FRETAFASBRA",
    "FWMVCROTAUTO",
    "MontaBlock",
    "A94EXLIBER",
    "ESTRUT",
    "A030ALTERA",
    "MSFCREATE",
    "TMSA200PRC",
    "HEADPROVA",
    "DETPROVA",
    "PARAMBOX",
    "FWUIWORKSHEET",
    "CrdXTitAtr",
    "MA410RODAP",
    "WRITEPROFDEF",
    "FINDPROFDEF",
    "CBOPENPORT",
    "FATATUEMPN",
    "MAAVALSC9",
    "VLDLOCALIZ",
    "A410MultT",
    "PivotTable",
    "A381Manut",
    "MATXFIS",
    "MaFisAdd",
    "CTGercomp",
    "WFNotifyAdmin",
    "a260Processa",
    "a415Tabela",
    "MaAvalCred",
    "A100Distri",
    "__SaveParam()",
    "A110APROV",
    "MDeMata103",
    "BuscaTaxa()",
    "CriaVar",
    "E_FIELD",
    "ApOleClient",
    "GetServerPort",
    "CheckStation",
    "CTBAFIN",
    "A415DESCAB",
    "A410RECALC",
    "X31UPDTABLE",
    "FA050Venc",
    "A097ProcLib",
    "MaAvLibPed",
    "A120Pedido",
    "LoadLayout()",
    "FtNfDevol",
    "FtNfVendas",
    "TK271CallCenter",
    "LJ7VENDA",
    "MA020PcCgc",
    "A140NFiscal",
    "procMonitorDoc",
    "ProxDoc",
    "PutMarcacoes",
    "Fa050Visua",
    "SaldoCt7",
    "F4LOTE",
    "CBRetEtiEan",
    "RetSldEnd",
    "A310Proc",
    "SpedNFeTrf",
    "SetPrvt",
    "TK273GRVPTC",
    "APPEXCEL",
    "VTNewEmpr",
    "TWFMAIL",
    "MaColsToFis",
    "FWAUTHUSER",
    "fBuscaSal",
    "XFUNWizard",
    "A410Altera",
    "MC050CON",
    "AVGXML2DBF",
    "MaLiberOk",
    "MaRgrDesc",
    "ApiForCli",
    "A415Baixa",
    "INFImpBMP",
    "STBCalcSald",
    "FVALBENNIF",
    "A450F4Con",
    "EECView",
    "CALLPROC",
    "TWorkspace",
    "TWorkspaceFolder",
    "ExplEstr",
    "RetFldProd",
    "STWMANAGREPORTPRINT",
    "CN300VlCli",
    "OpenFile",
    "__CopyFile",
    "MATFilCalc",
    "A161MapCot",
    "INFCodeBare",
    "INFTexto",
    "CallRM",
    "DistanciaGPS",
    "TECGtCoord",
    "NG420GRAVA",
    "RetSem",
    "nBIWeekOfYear",
    "TAvPrinter",
)

# Routine, module, type and tables of automatic routines.
ROUTINES = (
    ("MATA010", "SIGAEST", "cadastro", ["SB1"]),
    ("MATA020", "SIGACOM", "cadastro", ["SA2"]),
    ("MATA030", "SIGAFIN", "cadastro", ["SA1"]),
    ("MATA040", "SIGAFIN", "cadastro", ["SA6"]),
    ("MATA050", "SIGAFAT", "cadastro", ["SA4"]),
    ("MATA075", "SIGAEST", "movimento", ["SB8"]),
    ("MATA103", "SIGACOM", "movimento", ["SF1", "SD1", "SF4", "SE2"]),
    ("MATA110", "SIGACOM", "movimento", ["SC1"]),
    ("MATA112", "SIGAFIN", "cadastro", ["SE4"]),
    ("MATA120", "SIGACOM", "movimento", ["SC7"]),
    ("MATA125", "SIGACOM", "movimento", ["SCA", "SCB"]),
    ("MATA150", "SIGACOM", "movimento", ["SC8"]),
    ("MATA180", "SIGAEST", "cadastro", ["SB5"]),
    ("MATA220", "SIGAEST", "cadastro", ["SG1"]),
    ("MATA242", "SIGAPCP", "movimento", ["SD3"]),
    ("MATA261", "SIGAEST", "movimento", ["SD3"]),
    ("MATA310", "SIGAEST", "movimento", ["SD3"]),
    ("MATA311", "SIGAEST", "movimento", ["SD3"]),
    ("MATA410", "SIGAFAT", "movimento", ["SC5", "SC6", "SF4", "SB1"]),
    ("FATA010", "SIGAFAT", "cadastro", ["AE1"]),
    ("FATA050", "SIGAFAT", "movimento", ["SC9"]),
    ("MATA460", "SIGAFAT", "movimento", ["SF2", "SD2"]),
    ("MATA461", "SIGAFAT", "movimento", ["SF2", "SD2"]),
    ("FINA040", "SIGAFIN", "movimento", ["SE1"]),
    ("FINA050", "SIGAFIN", "movimento", ["SE2"]),
    ("FINA070", "SIGAFIN", "movimento", ["SE1", "SE5"]),
    ("FINA080", "SIGAFIN", "movimento", ["SE2", "SE5"]),
    ("CTBA102", "SIGACTB", "movimento", ["CT2"]),
    ("EECAP100", "SIGAEEC", "movimento", ["EEC", "EE7"]),
    ("TMSA500", "SIGATMS", "movimento", ["DT6"]),
)

#: Operations of automatic routines.
OPERATIONS = {3: "inclusao", 4: "alteracao", 5: "exclusao"}
