"""Declared schemas of manifests and corpora."""

MLS = "ID string, transcript string, duration double, sample_rate double, num_samples bigint"
UROMANIZED = MLS + ", tokenized array<string>, normalized array<string>, uroman array<string>"
ALIGNED = UROMANIZED + ", speech_tokens array<int>, aligned_token_start_time array<double>, aligned_token_end_time array<double>"
LEGACY = "alignment array<array<string>>, normalized array<string>, uroman array<string>, speech_tokens array<int>"
VOXPOPULI = "audio_id string, language int, raw_text string, normalized_text string, gender string, speaker_id string, is_gold_transcript boolean, accent string, path string"
GIGASPEECH = (
    "segment_id string, text string, audio_id string, path string, speaker string, begin_time double, end_time double, title string, url string, source int, category int, original_full_path string, sample_rate int"
)
GIGASPEECH_RAW = (
    "audios array<struct<title:string,url:string,path:string,aid:string,source:string,format:string,sample_rate:int,codec:string,channels:int,md5:string,duration:double,size:bigint,speaker:string,category:string,subsets:array<string>,"
    "segments:array<struct<sid:string,speaker:string,begin_time:double,end_time:double,text_raw:string,text_tn:string,subsets:array<string>>>>>"
)
CENTROIDS = "cluster int, vec array<double>"
FRAMES = "utt_id string, frame_idx int, vec array<float>"
