"""Word lists that several operators use. All are fixed values."""

# Common given names.
GIVEN_NAMES = frozenset(
    "james mary robert patricia john jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah charles karen "
    "christopher lisa daniel nancy matthew betty anthony margaret sandra donald ashley steven stephen kimberly paul emily andrew donna joshua michelle "
    "kenneth carol kevin amanda brian dorothy george melissa timothy deborah ronald stephanie edward rebecca jason sharon jeffrey laura ryan cynthia "
    "jacob kathleen gary amy nicholas angela eric shirley jonathan anna brenda larry pamela justin emma scott nicole brandon helen benjamin samantha "
    "samuel katherine gregory christine alexander debra frank rachel patrick carolyn raymond janet jack catherine dennis maria jerry heather "
    "paula hugo lucia omar amara marcus dmitri bruno irene gloria yusuf noel priya olga oscar helena ingrid carla ruth stella wanda simone dora "
    "inés inez gerald zoë leila frederick victor zachary rita keiko françois lawrence karl renée victoria theodore maría chloé jürgen björn naomi "
    "josé søren felix ines zoe francois renee chloe jurgen bjorn jose soren peter henry arthur walter diana julia claire alice martin simon".split()
)

# Given names that are ordinary words, months or seasons as well.
WORD_NAMES = frozenset("will may june april summer grace faith hope joy rose mark bill chase frank grant rich art dawn autumn hunter pat sue drew".split())

# Short forms of given names, spoken and written.
NICKNAMES = {
    "alexander": "alex al sandy xander alexr", "andrew": "andy drew", "anthony": "tony anty", "barbara": "barb babs", "benjamin": "ben benny benj", "catherine": "cathy kate",
    "charles": "charlie chuck chas", "christopher": "chris kit topher chr xtopher", "cynthia": "cindy", "daniel": "dan danny danl", "deborah": "deb debbie debby", "donald": "don",
    "edward": "ed eddie ted ned edw", "elizabeth": "liz beth betsy betty eliza lizzie", "frederick": "fred freddie freddy fredk", "gerald": "gerry jerry", "gregory": "greg gregg",
    "james": "jim jimmy jamie jas", "jennifer": "jen jenny", "john": "jack johnny", "jonathan": "jon", "jose": "pepe", "joseph": "joe joey jos", "katherine": "kathy kate katie kat",
    "kenneth": "ken kenny", "lawrence": "larry", "margaret": "maggie meg peggy margt", "matthew": "matt", "michael": "mike mick mickey", "nicholas": "nick nicky nichs", "pamela": "pam",
    "patricia": "pat patty tricia trish", "rebecca": "becca becky", "richard": "rick dick rich richd", "robert": "rob bob bobby robbie robt", "samuel": "sam sammy saml", "stephen": "steve steven stephn",
    "steven": "steve stephen", "susan": "sue susie", "theodore": "ted teddy theo", "thomas": "tom tommy thos", "timothy": "tim", "victoria": "vicky vicki tori", "victor": "vic",
    "william": "will bill billy liam wm", "zachary": "zach zack", "philip": "phil", "ronald": "ron", "raymond": "ray", "peter": "pete", "alexandra": "alex sandra", "jeffrey": "jeff",
}

COURTESY_TITLES = frozenset("mr mrs ms miss dr prof professor sir hon madam dame lord lady rev".split())
