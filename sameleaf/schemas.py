"""The tables, as Spark DDL."""

VECTOR = "map<string,int>"
DOCUMENTS = "file_hash string, file_name string, file_path string, metadata map<string,string>"
SENTENCES = f"file_hash string, page int, ord int, text string, vector {VECTOR}"
IMAGES = "file_hash string, page int, ord int, name string, image string, image_hash string, width int, height int"
PAIRS = "pair_id string, i int, j int, hash_l string, hash_r string, name_l string, name_r string"
SIDE = "struct<text:string,textB:string,pageNumber:int>"
TEXT_MATCH = f"struct<a:{SIDE},b:{SIDE},similarity:double>"
IMAGE_MATCH = "struct<images:array<string>,pages:array<int>,similarity:double>"
METADATA_MATCH = "struct<label:string,a:string,b:string,same:boolean>"
RESULTS = (
    "groupid string, uuid string, names array<string>, files array<string>, "
    f"textSimilarities array<{TEXT_MATCH}>, imageMatches array<{IMAGE_MATCH}>, metadataMatches array<{METADATA_MATCH}>, "
    "starttime bigint, addtime bigint, duration bigint, "
    "settings struct<text:struct<threshold:double,minLength:int>,image:struct<similarity:double,minSize:int>>"
)
ENTITIES = "entity string, type string, num int"
PARSED = (
    "fileName string, filePath string, fileHash string, metadata struct<info:map<string,string>>, "
    f"texts array<struct<pageNumber:int,text:string,vector:{VECTOR}>>, "
    "images array<struct<name:string,pageNumber:int,image:string,imageHash:string,width:int,height:int>>"
)
